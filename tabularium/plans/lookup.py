"""Lookup of a name over harvested publishers: best match of each, its documents' lines, and what went wrong."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.match import best_matches
from tabularium.operators.pieces import dealt
from tabularium.schema import LINES, LOAD_LINE, ROW, SHEET_ROWS, WORDS
from tabularium.session import settled
from tabularium.sources import positioned, publishers

#: A row without label tells why a source's listing is not there.
LISTING = "source string, ord bigint, label string, url string, error string"
#: ``ord`` is the listing entry's, null: any of that label. A document of stage ``page`` is the entry's own page, which failed.
HARVEST_DOCS = "doc_id string, source string, ord bigint, cartridge string, item_name string, source_url string, stage string, error string"


#: Labels that one task tokenises at most.
LABELS_EACH = 20_000
#: Documents up to this number, some 10 MB of names, are sent to every task, so that contents of others are dropped before they are read.
DOCS_SENT = 200_000


#: A table, or what makes one: it is given a function that leaves of any table with ``doc_id`` the rows of the documents asked for.
Contents = DataFrame | Callable[[Callable[[DataFrame], DataFrame]], DataFrame]


@dataclass(frozen=True)
class Shelf:
    """What was harvested: catalogues, their documents, and the documents' contents by kind."""

    listing: DataFrame
    docs: DataFrame
    lines: Contents
    words: Contents
    sheet_rows: Contents


def contents(of: Contents, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The contents that ``only`` leaves; what is made by a function is made of these documents alone."""
    return only(of) if isinstance(of, DataFrame) else of(only)


SCHEMAS = {"listing": LISTING, "docs": HARVEST_DOCS, "lines": LINES, "words": WORDS, "sheet_rows": SHEET_ROWS}


def open_shelf(spark: SparkSession, path: str) -> Shelf:
    """A shelf of Parquet tables, one folder each."""
    return Shelf(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()})


def save_shelf(shelf: Shelf, path: str) -> None:
    """Documents' contents lie by document, so that a lookup of few reads few files' row groups."""
    for n in SCHEMAS:
        df = contents(getattr(shelf, n), lambda whole: whole)
        (df.sortWithinPartitions("doc_id") if "doc_id" in df.columns else df).write.mode("overwrite").parquet(f"{path}/{n}")


@dataclass(frozen=True)
class Publisher:
    """A source: its name, how its documents are read, and what is said when they hold nothing."""

    name: str
    read: Callable[[Shelf, DataFrame], DataFrame]
    nothing: str


#: In the order of asking. A further source is one more entry. Names and messages are fixed values.
PUBLISHERS: dict[str, Publisher] = {
    "nosler": Publisher("Nosler", lambda s, d: publishers.from_layout_text(s.lines, d), "cartridge matched but no bullet-weight PDFs had usable data"),
    "sierra": Publisher("Sierra", lambda s, d: positioned.from_grid_words(s.words, d), "PDF fetched but no load tables could be parsed from it"),
    "speer": Publisher("Speer", lambda s, d: positioned.from_recipe_words(s.words, s.lines, d), "cartridge matched but no recipes had usable PDFs"),
    "hammer": Publisher("Hammer Bullets", lambda s, d: publishers.from_sheets(s.sheet_rows, d), "sheet fetched but no load tables had data yet (Hammer marks some as not-yet-published)"),
    "barnes": Publisher("Barnes", lambda s, d: positioned.from_section_words(s.words, s.lines, d), "PDF fetched but no load tables could be parsed from it"),
}


@dataclass(frozen=True)
class Lookup:
    """``lines`` is the flat fact; ``results`` has a row a source, in the order asked: ``pos, source, manufacturer, query, matched, n_tables, n_lines, errors, ok``."""

    query: str
    lines: DataFrame
    results: DataFrame


def chosen(sources: list[str] | None) -> list[str]:
    names = list(sources or PUBLISHERS)
    for n in names:
        if n not in PUBLISHERS:
            raise ValueError(f"unknown source: {n!r} (available: {', '.join(PUBLISHERS)})")
    return names


def lookup(shelf: Shelf, query: str, sources: list[str] | None = None) -> Lookup:
    """The best label of each source, the lines of its documents, and errors; a bad document costs only itself."""
    names = chosen(sources)
    spark = shelf.listing.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id int, text string")
    best = _best(shelf, asked, names)
    best = spark.createDataFrame(best.collect(), best.schema)  # a row a source at most
    met = settled(_documents(shelf, best))
    found = _looked_up(shelf, asked, names, best, met)
    return Lookup(query, found.lines.drop("query_id"), found.results.drop("query_id"))


@dataclass(frozen=True)
class Lookups:
    """The flat fact and the results of many names, as in :class:`Lookup`, each with ``query_id``."""

    lines: DataFrame
    results: DataFrame


def lookup_many(shelf: Shelf, queries: DataFrame, sources: list[str] | None = None) -> Lookups:
    """As :func:`lookup` of each of ``queries`` (``query_id, text``), in one plan: a document that several names match is read once.

    Defined cases: equal rows of queries are one; a null name has results, as of a name that matches nothing; no queries give none.
    """
    names = chosen(sources)
    asked = queries.select("query_id", "text").distinct()
    best = settled(_best(shelf, asked, names))  # every publisher's plan reads what names match and their documents
    return _looked_up(shelf, asked, names, best, settled(_documents(shelf, best)))


def _best(shelf: Shelf, asked: DataFrame, names: list[str]) -> DataFrame:
    listing = shelf.listing.filter(F.col("source").isin(*names) & F.col("label").isNotNull())
    # Of entries of one label only the first can be the best; labels are few where entries are many, and are read several times.
    first = listing.groupBy("source", "label").agg(F.min(F.struct("ord")).alias("first")).select("source", "label", "first.ord")
    first = settled(first)
    first = settled(dealt(first, ["source", "label"], first.count(), LABELS_EACH))  # tokens and letters of labels are far more than labels
    return best_matches(asked, first, limit=1).select("query_id", "source", F.col("label").alias("matched"), F.col("ord").alias("entry"))


def _documents(shelf: Shelf, best: DataFrame) -> DataFrame:
    """Documents of each query. Of entries of one label the first is the match, and only its documents are read."""
    docs = shelf.docs.withColumnRenamed("source", "_source")
    here = (F.col("_source") == best["source"]) & (docs["cartridge"] == best["matched"]) & F.coalesce(docs["ord"] == best["entry"], F.lit(True))
    return docs.join(best, here).select("query_id", "source", *[docs[c] for c in docs.columns if c != "_source"])


def _looked_up(shelf: Shelf, asked: DataFrame, names: list[str], best: DataFrame, met: DataFrame) -> Lookups:
    spark = shelf.listing.sparkSession
    # Sources without a document to read take no part in the plan; there are as many rows here as sources at most.
    some = {r["source"]: r["count"] for r in met.filter("error is null").groupBy("source").count().collect()}
    read = [n for n in names if n in some]

    def lines_of(name: str) -> DataFrame:
        mine = met.filter((F.col("source") == name) & F.col("error").isNull()).select("doc_id", "cartridge", "item_name", "source_url").distinct()
        ids = F.broadcast(mine.select("doc_id")) if some[name] <= DOCS_SENT else mine.select("doc_id")
        only = lambda df: df.join(ids, "doc_id", "left_semi")
        return PUBLISHERS[name].read(Shelf(shelf.listing, mine, *[contents(c, only) for c in (shelf.lines, shelf.words, shelf.sheet_rows)]), mine)

    lines = reduce(DataFrame.unionByName, [lines_of(n) for n in read], spark.createDataFrame([], LOAD_LINE))
    lines = lines.join(met.filter("error is null").select("query_id", "source", "doc_id").distinct(), ["source", "doc_id"]).select("query_id", *[f.name for f in lines.schema.fields])
    head = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("source"), F.lit(PUBLISHERS[n].name).alias("manufacturer"), F.lit(PUBLISHERS[n].nothing).alias("nothing")) for i, n in enumerate(names)])
    head = asked.select("query_id", F.col("text").alias("query"), F.explode(head).alias("h")).select("query_id", "query", "h.*")
    counts = lines.groupBy("query_id", "source").agg(F.count_distinct("doc_id", "table_ord").alias("n_tables"), F.count(F.lit(1)).alias("n_lines"))
    step = F.when(F.col("stage") == "page", "failed to load cartridge page ").otherwise("failed to fetch/parse ")
    bad = F.concat(step, F.coalesce("source_url", F.lit("")), F.lit(": "), F.col("error"))
    failed = met.filter("error is not null").groupBy("query_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", bad.alias("m")))), lambda x: x["m"]).alias("failed"))
    stock = shelf.listing.filter(F.col("source").isin(*names)).groupBy("source").agg(F.count("label").alias("stock"), F.min("error").alias("why"))
    out = head.join(stock, "source", "left")
    for told in (best, counts, failed):
        out = out.join(told, ["query_id", "source"], "left")
    failed_or_none = F.coalesce("failed", F.array().cast("array<string>"))
    errors = (
        F.when(F.coalesce("stock", F.lit(0)) == 0, F.array(F.concat(F.lit("could not load cartridge list: "), F.coalesce("why", F.lit("nothing harvested")))))
        .when(F.col("matched").isNull(), F.array(F.lit("no matching cartridge found")))
        .when(F.col("n_lines").isNull() & (F.size(failed_or_none) == 0), F.array("nothing"))
        .otherwise(failed_or_none)
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    results = out.select("query_id", "pos", "source", "manufacturer", "query", "matched", zero("n_tables"), zero("n_lines"), errors.alias("errors"))
    return Lookups(lines, results.withColumn("ok", (F.col("n_tables") > 0) & (F.size("errors") == 0)))


def rows(lines: DataFrame) -> DataFrame:
    """The eight columns of a load line, without what its table says."""
    return lines.select(*ROW)


__all__ = ["LOAD_LINE", "PUBLISHERS", "Lookup", "Lookups", "Publisher", "Shelf", "chosen", "lookup", "lookup_many", "open_shelf", "rows", "save_shelf"]
