"""Extraction plans: from recovered lines, sheet rows or words to the flat fact of load lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.functions import text as t
from tabularium.operators.sequence import forward_fill_if, sheet_islands
from tabularium.schema import LOAD_LINE

# The printed forms of each layout.
TEXT_ROW = r"^\s*([A-Za-z][A-Za-z0-9 .#\-®]*?)?\s{2,}(\d+\.?\d*)\s+(\*{0,2}\s*(?:MAX\.)?)\s*(\d+)\s+.*?(\d+)%\s*$"
TEXT_META = {
    "case_name": r"CASE TYPE:\s*(\S+)",
    "primer": r"(?dm)PRIMER TYPE\s+(\S.*?)\s*$",
    "barrel": r"(?dm)BARREL Length/Make\s+(\S.*?)\s*$",
    "twist": r"(?dm)BARREL Twist\s+(\S.*?)\s*$",
    "coal_in": r"(?dm)TESTED O\.A\.C\.L\.\s+(\S.*?)\s*$",
}
SHEET_SKIP = r"(?i)always start low|not responsible|for your load process"
SHEET_NOTE = r"(?i)^\s*[*√]|^shorter than saami|^minimal coal published"

_FACT = [tuple(f.split(" ")) for f in LOAD_LINE.split(", ")]
_EMPTY = {"bullet_type", "bullet_id", "case_name", "primer", "barrel", "twist", "test_firearm", "source_url", "notes", "flags"}


def as_load_lines(rows: DataFrame, **given: Column) -> DataFrame:
    """The fact's columns in order: those given, those of ``rows``, else empty or null."""
    have = set(rows.columns)
    pick = lambda n: given[n] if n in given else F.col(n) if n in have else F.lit("" if n in _EMPTY else None)
    return rows.select(*[pick(n).cast(kind).alias(n) for n, kind in _FACT])


def from_layout_text(lines: DataFrame, docs: DataFrame, source: str = "nosler", manufacturer: str = "Nosler") -> DataFrame:
    """Text tables whose powder stands on its MAX. row alone and holds until the next."""
    part = lambda k: F.regexp_extract("line", TEXT_ROW, k)
    rows = lines.filter(F.rlike("line", F.lit(TEXT_ROW))).select("doc_id", "line_no", t.strip(part(1)).alias("name"), part(2).cast("double").alias("charge_gr"), part(3).alias("mark"), part(4).cast("double").alias("velocity_fps"))
    rows = rows.withColumn("is_max", F.contains("mark", F.lit("MAX.")))
    rows = forward_fill_if(rows, ["doc_id"], ["line_no"], F.col("name"), F.col("is_max") & (F.col("name") != ""), "powder")
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("whole"))
    meta = whole.select("doc_id", *[(t.first_group(F.col("whole"), p) if n == "coal_in" else F.coalesce(t.first_group(F.col("whole"), p), F.lit(""))).alias(n) for n, p in TEXT_META.items()])
    out = rows.join(meta, "doc_id").join(docs.select("doc_id", "cartridge", "item_name", "source_url"), "doc_id")
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1
    out = out.withColumns({"line_ord": order, "bullet_weight_gr": t.leading_number(F.col("item_name")), "bullet_type": t.bullet_type(F.col("item_name")), "flags": F.when(F.contains("mark", F.lit("*")), "most accurate").otherwise("")})
    return as_load_lines(out, source=F.lit(source), manufacturer=F.lit(manufacturer), table_ord=F.lit(0))


def from_sheets(rows: DataFrame, docs: DataFrame, source: str = "hammer", manufacturer: str = "Hammer Bullets") -> DataFrame:
    """Printed sheets: META, BULLET, HEADER and DATA rows by position."""
    cell = lambda k: t.strip(F.coalesce(F.get(F.col("cells"), F.lit(k)), F.lit("")))
    at = rows.select("doc_id", "row_no", *[cell(k).alias(f"c{k}") for k in range(7)])
    some = F.concat(*[F.col(f"c{k}") for k in range(7)]) != ""
    at = at.filter(some & ~F.rlike("c1", F.lit(SHEET_SKIP)) & ~F.rlike("c1", F.lit(SHEET_NOTE)))
    low = F.lower("c2")
    kind = F.when(F.contains(low, F.lit("barrel length")), "META").when(F.contains(low, F.lit("twist rate")), "BULLET").when((F.col("c1") == "Powder") & (F.col("c2") == "Start"), "HEADER").otherwise("DATA")
    item = F.struct(t.strip(F.ltrim(F.col("c1"), F.lit("†"))).alias("name"), t.without(F.col("c2"), r"(?i)twist rate or faster\s*").alias("twist"), F.col("c4").alias("bc"), t.without(F.col("c5"), "[√*]").alias("coal"))
    meta = F.struct(t.without(F.col("c5"), r"(?i)case\s*").alias("case"), t.without(F.col("c2"), r"(?i)barrel length\s*").alias("barrel"))
    data = sheet_islands(at, ["doc_id"], "row_no", kind, item, meta).filter("c1 != ''")
    start, _ = t.value_and_flags(F.col("c2"))
    first, _ = t.value_and_flags(F.col("c4"))
    top, flags = t.value_and_flags(F.col("c6"))
    data = data.withColumns({"charge_min_gr": start, "velocity_min_fps": first, "velocity_fps": top, "flags": flags}).filter("charge_min_gr is not null or velocity_fps is not null")
    text = lambda c: F.coalesce(c, F.lit(""))
    tables = F.dense_rank().over(W.partitionBy("doc_id").orderBy("table_id")) - 1
    order = F.row_number().over(W.partitionBy("doc_id", "table_id").orderBy("row_no")) - 1
    out = data.withColumns({"table_ord": tables, "line_ord": order}).join(docs.select("doc_id", "cartridge", "source_url"), "doc_id")
    name, bc = text(F.col("item.name")), text(F.col("item.bc"))
    return as_load_lines(
        out,
        source=F.lit(source),
        manufacturer=F.lit(manufacturer),
        bullet_weight_gr=t.leading_number(name),
        bullet_type=name,
        coal_in=F.nullif(F.col("item.coal"), F.lit("")),
        case_name=text(F.col("meta.case")),
        barrel=text(F.col("meta.barrel")),
        twist=text(F.col("item.twist")),
        notes=F.when(bc != "", F.concat(F.lit("BC "), bc)).otherwise(""),
        powder=F.col("c1"),
        is_max=F.lit(True),
    )


def csv_rows(files: DataFrame) -> DataFrame:
    """``doc_id, row_no, cells`` of whole CSV texts (``doc_id, value``); quoted line ends belong to their cell."""
    import csv
    import io
    from collections.abc import Iterator

    import pyarrow as pa

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = list(csv.reader(io.StringIO(value or "")))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["doc_id", "row_no", "cells"])

    return files.select("doc_id", "value").mapInArrow(parsed, "doc_id string, row_no int, cells array<string>")


def text_lines(texts: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of whole texts (``doc_id, value``)."""
    return texts.select("doc_id", F.posexplode(t.split_lines(F.col("value"))).alias("line_no", "line"))
