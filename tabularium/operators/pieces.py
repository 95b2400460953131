"""Keys of many rows, cut into pieces of their order, so that work on one key is many tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_EACH = 1_000_000


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = "_" + name
    return name


def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Equal in all columns, nulls included."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def _below(splits: Column, x: Column, most: int) -> Column:
    """How many of the sorted ``splits`` (``most`` at most) are less than ``x``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda got, step: F.when(F.get(splits, got + step - 1) < x, got + step).otherwise(got))


def cut(df: DataFrame, keys: list[str], coord: str, out: str, rows_each: int = ROWS_EACH) -> tuple[DataFrame, bool]:
    """Adds the number of each row's piece, and says whether any key has more than one.

    Keys of more than ``rows_each`` rows are cut at quantiles of their coordinates; rows of one coordinate stay together.
    There are as many hot keys, and as many cuts, as the rows allow at that size, so both go by way of the driver.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_each).collect()
    if not hot:
        return df.withColumn(out, F.lit(0)), False
    spark = df.sparkSession
    known = spark.createDataFrame([tuple(r)[:-1] for r in hot], df.select(*keys).schema)
    parts = math.ceil(max(r["n"] for r in hot) / rows_each)
    places = F.percentile_approx(coord, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 20 * parts)
    told = df.join(F.broadcast(known), same(df, known, *keys), "left_semi").groupBy(*keys).agg(F.array_sort(F.array_distinct(places)).alias("s")).collect()
    splits = spare(df, "splits")
    schema = df.select(*keys).schema.add(splits, df.select(F.array(coord)).schema[0].dataType)
    held = spark.createDataFrame([tuple(r) for r in told], schema)
    both = df.join(F.broadcast(held), same(df, held, *keys), "left")
    return both.select(*[df[c] for c in df.columns], F.coalesce(_below(held[splits], df[coord], parts), F.lit(0)).alias(out)), True


def dealt(df: DataFrame, keys: list[str], rows: int, rows_each: int = ROWS_EACH) -> DataFrame:
    """``df`` by ``keys`` in as many tasks as exchanges have, and in more where ``rows`` are more than ``rows_each`` a task.

    A task then holds as much of a large table as of a small one; tasks are not merged while the query runs.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(rows / rows_each)), *keys)


def starts(columns: list[pa.ChunkedArray | pa.Array]) -> np.ndarray:
    """Where rows of sorted columns differ from the row before; the first row does."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """A sorted stream in tables of about ``rows`` rows, or more where one group has more: no group is in two of them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(np.flatnonzero(starts([table.column(c) for c in columns]))[-1])
        if last:
            yield table.slice(0, last)
            held, n = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
