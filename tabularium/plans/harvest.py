"""Harvest what a lookup of one name needs: listings, the matching entries' pages and documents, as a shelf of tables.

Every request is a row of one distributed fetch, and what it brought is written before it is used, so nothing is asked
for twice. A listing, page or document that fails is a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.match import best_matches
from tabularium.functions.text import absolute
from tabularium.plans.lookup import SCHEMAS, Shelf, chosen, open_shelf
from tabularium.sources import documents, listings, publishers, web

# Where publishers list their documents.
LISTING_PAGES = {
    "nosler": ["https://www.nosler.com/load-data/caliber-and-cartridge-data.html"],
    "sierra": ["https://sierrabullets.com/load-data/"],
    "speer": ["https://reloadingdata.speer.com/SpeerReloading/Handgun", "https://reloadingdata.speer.com/SpeerReloading/Rifle"],
    "hammer": ["https://hammerbullets.com/load-data/"],
    "barnes": ["https://barnesbullets.com/load-data/"],
}
RECIPE_BASE = "https://reloadingdata.speer.com"
GATES = (web.Gate("https://hammerbullets.com/load-data/", (("age_gate[confirm]", "1"), ("age_gate[lang]", "en")), "age_gate[age]"),)
SHEET_URL = "https://docs.google.com/spreadsheets/d/{}/export?format=csv"
#: How documents of each publisher are read.
AS_TEXT, AS_WORDS = ("nosler", "speer", "barnes"), ("sierra", "speer", "barnes")

#: ``url`` in, ``url, content, error`` out.
Fetch = Callable[[DataFrame], DataFrame]
_ENTRY = "source string, ord bigint, label string, url string, sheet_id string, recipes array<struct<name:string,pdf_url:string>>, error string"


def fetch_all(requests: DataFrame) -> DataFrame:
    return web.fetch(requests, GATES)


def list_entries(spark: SparkSession, source: str, get: Fetch, pages: dict[str, list[str]] | None = None) -> DataFrame:
    """The catalogue of one source, in the columns of an entry; a source whose pages fail is a row without label."""
    urls = (pages or LISTING_PAGES)[source]
    asked = spark.createDataFrame(list(enumerate(urls)), "page_ord int, url string")
    got = asked.join(get(asked), "url").withColumn("html", F.decode("content", "utf-8"))
    good = got.filter("error is null").select("page_ord", "html")
    if source == "speer":
        merged = listings.merge_catalogue(listings.recipe_entries(good), ["page_ord", "kind", "ord"])
        order = F.col("first.page_ord").cast("long") * (4 * listings.PAGE_LINKS) + F.col("first.kind") * listings.PAGE_LINKS + F.col("first.ord")
        found = merged.select(F.lit(source).alias("source"), order.alias("ord"), "label", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("sheet_id"), "recipes")
    else:
        found = listings.list_items(good, source).withColumn("recipes", F.lit(None).cast("array<struct<name:string,pdf_url:string>>"))
    none = F.lit(None)
    bad = got.filter("error is not null").select(F.lit(source).alias("source"), F.lit(-1).cast("long").alias("ord"), none.cast("string").alias("label"), "url", none.cast("string").alias("sheet_id"), none.cast("array<struct<name:string,pdf_url:string>>").alias("recipes"), "error")
    return found.withColumn("error", none.cast("string")).unionByName(bad)


def _documents(source: str, entries: DataFrame, get: Fetch) -> DataFrame:
    """``source, ord, cartridge, item_name, url, stage, error`` of the documents behind matching entries."""
    none, at = F.lit(None).cast("string"), [F.lit(source).alias("source"), "ord", F.col("label").alias("cartridge")]
    if source == "nosler":
        pages = entries.join(get(entries.select("url")).withColumnRenamed("error", "_error"), "url").withColumn("html", F.decode("content", "utf-8"))
        tabs = listings.second_hop(pages.filter("_error is null").select("source", F.col("ord").alias("entry"), "label", "html"))
        good = tabs.select(F.lit(source).alias("source"), F.col("entry").alias("ord"), F.col("label").alias("cartridge"), F.col("name").alias("item_name"), F.col("pdf_url").alias("url"), F.lit("document").alias("stage"), none.alias("error"))
        return good.unionByName(pages.filter("_error is not null").select(*at, none.alias("item_name"), "url", F.lit("page").alias("stage"), F.col("_error").alias("error")))
    if source == "speer":
        each = entries.select("*", F.explode("recipes").alias("r")).filter("r.pdf_url != ''")
        return each.select(*at, F.col("r.name").alias("item_name"), absolute(F.col("r.pdf_url"), RECIPE_BASE).alias("url"), F.lit("document").alias("stage"), none.alias("error"))
    head, _, tail = SHEET_URL.partition("{}")
    url = F.concat(F.lit(head), "sheet_id", F.lit(tail)) if source == "hammer" else F.col("url")
    return entries.select(*at, F.lit("").alias("item_name"), url.alias("url"), F.lit("document").alias("stage"), none.alias("error"))


def harvest(spark: SparkSession, query: str, path: str, sources: list[str] | None = None, get: Fetch = fetch_all, words: documents.WordReader = documents.read_words, text: documents.TextReader = documents.read_layout, cache: str | None = None, now: float | None = None, pages: dict[str, list[str]] | None = None) -> Shelf:
    """Write a shelf for one name under ``path`` and open it. ``cache`` is a folder in which listings are kept for a week."""
    import time

    now = time.time() if now is None else now
    names, kept = chosen(sources), f"{path}/work"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{kept}/{name}")
        return spark.read.schema(df.schema).parquet(f"{kept}/{name}")

    def entries_of(source: str) -> DataFrame:
        old = listings.load_cache(spark, f"{cache}/{source}", now) if cache else None
        if old is not None:
            return spark.createDataFrame([], _ENTRY).unionByName(old)
        new = put(list_entries(spark, source, get, pages), f"listing-{source}")
        if cache:
            listings.save_cache(new.filter("error is null"), f"{cache}/{source}", now)
        return new

    listed = put(reduce(DataFrame.unionByName, [entries_of(n) for n in names]), "entries")
    asked = spark.createDataFrame([(0, query)], "query_id int, text string")
    best = best_matches(asked, listed.filter("label is not null"), limit=1).select("source", "ord")
    matched = put(listed.filter("label is not null").join(F.broadcast(best), ["source", "ord"], "left_semi"), "matched")
    docs = put(reduce(DataFrame.unionByName, [_documents(n, matched.filter(F.col("source") == n), get) for n in names]), "documents")
    got = put(get(docs.filter("error is null").select("url")).withColumnRenamed("error", "lost"), "contents")
    # Equal urls of one source are documents each, in the order of their names.
    docs = docs.withColumn("doc_id", F.concat_ws("/", "source", "ord", "item_name", "url"))
    held = docs.join(got.filter("lost is null"), "url").select("doc_id", "source", "content")
    seen = put(documents.words_of(held.filter(F.col("source").isin(*AS_WORDS)), words), "words")
    laid = put(documents.texts_of(held.filter(F.col("source").isin(*AS_TEXT)), text), "texts")
    sheets = held.filter("source = 'hammer'").select("doc_id", F.decode("content", "utf-8").alias("value"))
    torn = seen.filter("error is not null").select("doc_id", F.col("error").alias("torn")).unionByName(laid.filter("error is not null").select("doc_id", F.col("error").alias("torn")))
    torn = torn.groupBy("doc_id").agg(F.min("torn").alias("torn"))
    told = docs.join(got.select("url", "lost"), "url", "left").join(torn, "doc_id", "left").withColumn("error", F.coalesce("error", "lost", "torn"))
    shelf = Shelf(
        listing=listed.select("source", "ord", "label", "url", "error"),
        docs=told.select("doc_id", "source", "ord", "cartridge", "item_name", F.col("url").alias("source_url"), "stage", "error").distinct(),
        lines=publishers.text_lines(laid.filter("error is null").select("doc_id", "value")).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line"),
        words=seen.filter("error is null").drop("error"),
        sheet_rows=publishers.csv_rows(sheets),
    )
    for name in SCHEMAS:
        getattr(shelf, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return open_shelf(spark, path)
