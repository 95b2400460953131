"""Operators that carry state along an order, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.operators.geometry import spare


def forward_fill_if(df: DataFrame, keys: list[str], order: list[str], value: Column, when: Column, out: str) -> DataFrame:
    """Carries ``value`` forward from the rows where ``when`` holds; rows before the first are dropped.

    Defined cases: a null value is not carried, the one before it is; null keys are a group; rows that tie in ``order`` have
    no order among them, so it must tell rows apart; no rows give none; ``out`` replaces a column of its name.
    """
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(when, value), ignorenulls=True).over(w)).filter(F.col(out).isNotNull())


def last_in_group(keys: list[str], order: list[Column]) -> Column:
    """True on the last row of each group."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1


def sheet_islands(rows: DataFrame, keys: list[str], order: str, kind: Column, item: Column, meta: Column) -> DataFrame:
    """Data rows of a printed sheet, with ``table_id``, ``item`` and ``meta`` of the table they belong to.

    Kinds are META, BULLET, HEADER and DATA. META and HEADER open a segment; a table is active from its HEADER to the
    next of either. A table's bullet is the first BULLET of the segment that its HEADER ends; its meta is the last META.

    Defined cases: rows of another or no kind open nothing and are left out; what is missing above a table is null; null
    keys are a sheet; no rows give none. The three names are replaced where ``rows`` has them; its other columns stay.
    """
    w = W.partitionBy(*keys).orderBy(order)
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    own = {n: spare(rows, n) for n in ("kind", "said", "seg", "active", "first")}
    opens = kind.isin("META", "HEADER")
    out = rows.withColumns(
        {
            own["kind"]: kind,
            own["said"]: item,
            own["seg"]: F.coalesce(F.sum(F.when(opens, 1).otherwise(0)).over(before), F.lit(0)),
            own["active"]: F.coalesce(F.last(F.when(opens, kind), ignorenulls=True).over(upto) == "HEADER", F.lit(False)),
            "table_id": F.coalesce(F.sum(F.when(kind == "HEADER", 1).otherwise(0)).over(upto), F.lit(0)),
            "meta": F.last(F.when(kind == "META", meta), ignorenulls=True).over(upto),
        }
    )
    in_seg = W.partitionBy(*keys, own["seg"]).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn(own["first"], F.first(F.when(F.col(own["kind"]) == "BULLET", F.col(own["said"])), ignorenulls=True).over(in_seg))
    out = out.withColumn("item", F.last(F.when(F.col(own["kind"]) == "HEADER", F.struct(F.col(own["first"]).alias("v"))), ignorenulls=True).over(upto)["v"])
    return out.filter((F.col(own["kind"]) == "DATA") & F.col(own["active"])).drop(*own.values())
