"""Catalogues of publishers from HTML pages and embedded JSON, their merge, and their cache."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.text import absolute, name_before_weight, normalize, strip, without_link_note
from tabularium.sources.html import anchors, first_links, links_inside

CACHE_SECONDS = 7 * 24 * 3600.0
KEPT_VERSIONS = 2
PAGE_LINKS = 1 << 32
#: Conditions of a store that has no readable listing.
_MISSES = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE")


@dataclass(frozen=True)
class ListingRule:
    """How a publisher's page names its documents."""

    base: str
    href: str
    drop: str = ""
    inside: str = ""
    link_note: bool = False
    sheet: bool = False


#: Which links of each publisher's page are documents.
LISTING_RULES = {
    "nosler": ListingRule("https://www.nosler.com", "^http", inside="load-data-tab-container"),
    "sierra": ListingRule("https://sierrabullets.com", r"(?i)^(?=.*/load-data/).*\.pdf$"),
    "barnes": ListingRule("https://barnesbullets.com", r"(?i)^(?=.*/barnes-loaddata/).*\.pdf$", drop="(?i)recall", link_note=True),
    "hammer": ListingRule("https://hammerbullets.com", r"/spreadsheets/d/([a-zA-Z0-9_-]+)", sheet=True),
}


def list_items(pages: DataFrame, source: str) -> DataFrame:
    """``source, ord, label, url, sheet_id`` from ``page_ord, html``. ``ord`` rises with page and place; no sort is needed for it."""
    rule = LISTING_RULES[source]
    found = (links_inside(pages, "div", rule.inside) if rule.inside else anchors(pages)).filter(F.rlike("href", F.lit(rule.href)))
    if rule.drop:
        found = found.filter(~F.rlike("href", F.lit(rule.drop)))
    found = found.withColumn("label", without_link_note(F.col("label")) if rule.link_note else F.col("label")).filter("label != ''")
    sheet = F.regexp_extract("href", rule.href, 1) if rule.sheet else F.lit(None).cast("string")
    order = F.col("page_ord").cast("long") * PAGE_LINKS + F.col("ord")
    return found.select(F.lit(source).alias("source"), order.alias("ord"), "label", absolute(F.col("href"), rule.base).alias("url"), sheet.alias("sheet_id"))


def second_hop(pages: DataFrame, base: str = "https://www.nosler.com") -> DataFrame:
    """``name, pdf_url`` of the first link of every element with a tab name, where it is a PDF."""
    found = first_links(pages, "data-tab-name").filter(F.lower("href").endswith(".pdf"))
    return found.withColumn("pdf_url", absolute(F.col("href"), base)).drop("href")


RECIPES = "cartridges array<struct<value:string,label:string>>, recipes array<struct<name:string,pdf_url:string,cartridge:array<string>>>"


def embedded_json(html: Column, variable: str = "var recipeJson", schema: str = RECIPES) -> Column:
    """The object that a script assigns; what follows it is ignored, an absent one is null."""
    at = F.locate(variable, html)
    rest = F.substr(html, at)
    return F.when(at > 0, F.from_json(F.substr(rest, F.locate("{", rest)), schema))


def recipe_entries(pages: DataFrame) -> DataFrame:
    """``page_ord, kind, ord, label, name, pdf_url`` of the JSON recipes and of every PDF link, in order."""
    data = pages.select("page_ord", embedded_json(F.col("html")).alias("d"))
    named = data.select("page_ord", F.posexplode("d.cartridges").alias("i", "c")).groupBy("page_ord", F.col("c.value").alias("value")).agg(F.max_by("c.label", "i").alias("known"))
    recipes = data.select("page_ord", F.posexplode("d.recipes").alias("r_ord", "r")).select("page_ord", "r_ord", "r.name", "r.pdf_url", F.posexplode("r.cartridge").alias("c_ord", "value"))
    first = recipes.join(named, ["page_ord", "value"], "left").select("page_ord", F.lit(0).alias("kind"), (F.col("r_ord") * 100_000 + F.col("c_ord")).alias("ord"), F.coalesce("known", "value").alias("label"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("pdf_url", F.lit("")).alias("pdf_url"))
    links = anchors(pages).filter(F.lower("href").endswith(".pdf")).withColumn("full", strip(F.replace("label", F.lit("\u00a0"), F.lit(" ")))).filter("full != ''")
    second = links.select("page_ord", F.lit(1).alias("kind"), "ord", name_before_weight(F.col("full")).alias("label"), F.col("full").alias("name"), F.col("href").alias("pdf_url"))
    return first.unionByName(second).withColumn("label", strip(F.col("label"))).filter("label != '' and pdf_url != ''")


def merge_catalogue(entries: DataFrame, order: list[str], key: Column | None = None) -> DataFrame:
    """Entries of one normal name become one: the first label, all recipes in order, none dropped."""
    key = normalize(F.col("label")) if key is None else key
    at = F.struct(*order)
    return entries.withColumn("key", key).groupBy("key").agg(F.min_by("label", at).alias("label"), F.min(at).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.struct("name", "pdf_url").alias("r")))), lambda x: x["r"]).alias("recipes"))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions of a kept listing, the newest first. A version is whole once its writer has marked it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    at = lambda name, of: spark._jvm.org.apache.hadoop.fs.Path(of, name)
    names = [x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()]
    return sorted((n for n in names if n.startswith("v-") and fs.exists(at("_SUCCESS", at(n, root)))), reverse=True)


def save_cache(items: DataFrame, path: str, now: float) -> None:
    """Keep a listing with its time, as a new version beside those before it; an empty one is not kept.

    Readers take the newest whole version, so that they have the one before while this is written, and never a part of it.
    The ``KEPT_VERSIONS`` newest stay for those who read them still.
    """
    if not items.limit(1).count():
        return
    spark = items.sparkSession
    items.withColumn("saved_at", F.lit(now)).write.parquet(f"{path}/v-{int(now * 1000):016d}-{uuid.uuid4().hex}")
    for name in _versions(spark, path)[KEPT_VERSIONS:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def refresh_cache(items: DataFrame, path: str, now: float, keys: list[str]) -> None:
    """Keep a listing together with the kept rows whose ``keys`` it does not have, nulls included, as a new version.

    What is kept on keeps its values and takes the new time; where there is nothing kept, this is :func:`save_cache`.
    """
    spark, names = items.sparkSession, _versions(items.sparkSession, path)
    if names:
        old = spark.read.parquet(f"{path}/{names[0]}").drop("saved_at")
        same = reduce(Column.__and__, [old[k].eqNullSafe(items[k]) for k in keys])
        items = items.unionByName(old.join(items, same, "left_anti"))
    save_cache(items, path, now)


def fresh(items: DataFrame, now: float, most: float = CACHE_SECONDS) -> DataFrame:
    """Rows kept at most ``most`` seconds ago; those of the very limit still count."""
    return items.filter(F.lit(now) - F.col("saved_at") <= most)


def load_cache(spark: SparkSession, path: str, now: float, most: float = CACHE_SECONDS) -> DataFrame | None:
    """A kept listing of at most ``most`` seconds; None where there is none or its files cannot be read. Other failures are raised."""
    try:
        names = _versions(spark, path)
        if not names:
            return None
        items = fresh(spark.read.parquet(f"{path}/{names[0]}"), now, most)
        return items.drop("saved_at") if items.limit(1).count() else None
    except PySparkException as e:
        if any((e.getCondition() or "").startswith(c) for c in _MISSES) or any(c in str(e) for c in _MISSES):
            return None
        raise
