"""Operators on coordinates: clusters, nearest columns, bands, exclusive pairing. All keys and tolerances are arguments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabularium.operators.pieces import ROWS_EACH, cut, same, spare, starts, whole_groups

def cluster_anchored(df: DataFrame, keys: list[str], coord: str, tol: float, out: str = "anchor", split: bool = False, rows_each: int = ROWS_EACH) -> DataFrame:
    """Adds the coordinate of each row's cluster: the first that no earlier cluster reaches within ``tol``.

    Anchors do not chain, unlike sessions. A sorted stream with one anchor of state, so groups may be of any size; rows without
    a coordinate come first in it, so that ``df`` is computed once. With
    ``split`` a group of more than ``rows_each`` rows is many tasks: each piece of its order tells which anchor it leaves for
    whichever it is entered with (:func:`_passage`), these are followed from piece to piece, and then pieces stream on their own.

    Defined cases: a null coordinate is in no cluster (null anchor); null keys are a group, and without keys all rows are
    one; with a ``tol`` of 0 each coordinate is a cluster, a negative one is an error; repeated rows share a cluster.
    """
    if tol < 0:
        raise ValueError("a tolerance is not negative")
    if not keys:
        lone = spare(df, "lone")
        return cluster_anchored(df.withColumn(lone, F.lit(0)), [lone], coord, tol, out, split, rows_each).drop(lone)
    kind, columns = df.schema[coord].dataType, df.columns
    piece, entry = spare(df, "piece"), spare(df, "entry")
    by = [*keys, piece] if split else keys
    placed, many = cut(df.filter(F.col(coord).isNotNull()), keys, coord, piece, rows_each) if split else (df, False)
    ordered = lambda x: x.repartition(*by).sortWithinPartitions(*by, coord)
    if many:
        told = T.StructType([*placed.select(*by).schema.fields, *[T.StructField(n, T.ArrayType(kind)) for n in ("_from", "_leave")], T.StructField("_last", kind)])
        hot = placed.filter(F.col(piece) > 0).select(*keys).distinct()
        own = placed.select(*by, coord).distinct()
        passages = ordered(own.join(F.broadcast(hot), same(own, hot, *keys), "left_semi")).mapInArrow(_passages(by, coord, tol), told)
        entries = passages.repartition(*keys).sortWithinPartitions(*by).mapInArrow(_followed(keys, piece, tol), T.StructType([*placed.select(*by).schema.fields, T.StructField("_entry", kind)]))
        placed = placed.join(entries, same(placed, entries, *by), "left").select(*[placed[c] for c in (*columns, piece)], F.col("_entry").alias(entry))
    else:
        placed = placed.withColumn(entry, F.lit(None).cast(kind))
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(coord)
            lost, x = own.is_null(), (own.fill_null(0) if own.null_count else own).to_numpy(zero_copy_only=False)
            got, values = [], x.tolist()
            first = np.flatnonzero(starts([*(b.column(k) for k in by), lost])).tolist()
            names = list(zip(*(c.take(pa.array(first)).to_pylist() for c in (lost, *(b.column(k) for k in by), b.column(entry)))))
            for (*name, entered), i, end in zip(names, first, [*first[1:], len(values)]):
                if name != key:
                    key, anchor = name, values[i] if entered is None else entered
                for v in values[i:end]:
                    if v - anchor > tol:
                        anchor = v
                    got.append(anchor)
            anchors = pa.array(np.array(got, x.dtype), mask=lost.to_numpy(zero_copy_only=False)) if own.null_count else pa.array(np.array(got, x.dtype))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), anchors], names=[*columns, out])

    if not split:
        # A window leaves rows of a key together and in order, and deals them out only where they are not together yet.
        placed = placed.withColumn(piece, F.row_number().over(W.partitionBy(*keys).orderBy(coord)))
        return placed.sortWithinPartitions(*keys, coord).mapInArrow(streamed, schema)
    found = ordered(placed).mapInArrow(streamed, schema)
    return found.unionByName(df.filter(F.col(coord).isNull()).withColumn(out, F.lit(None).cast(kind)))


def gathered_clusters(items: Column, coord: str, tol: float) -> Column:
    """The clusters of :func:`cluster_anchored` of items that are gathered already, such as the words of a page: an array of ``anchor, items`` by anchor.

    Time grows with items times clusters, so that this is for few. Items without a coordinate are in no cluster; none, or a null array, give none.
    """
    if tol < 0:
        raise ValueError("a tolerance is not negative")
    xs = F.sort_array(F.filter(F.transform(items, lambda w: w[coord]), lambda x: x.isNotNull()))
    beyond = lambda x, anchor: F.coalesce(~F.isnan(x - anchor) & (x - anchor > tol), F.lit(True))
    inside = lambda a, after: F.filter(items, lambda w: (w[coord] >= a) & F.coalesce(w[coord] < after, F.lit(True)))
    clusters = lambda anchors: F.zip_with(anchors, F.slice(anchors, F.lit(2), F.size(anchors)), lambda a, after: F.struct(a.alias("anchor"), inside(a, after).alias("items")))
    return F.aggregate(xs, F.slice(xs, 1, 0), lambda got, x: F.when(beyond(x, F.get(got, F.size(got) - 1)), F.concat(got, F.array(x))).otherwise(got), clusters)


def _passage(x: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct coordinates the anchor that is left behind, for whichever anchor before them they are entered with.

    The first coordinate beyond the entering anchor's reach is an anchor, and from each anchor on the next is fixed; where
    the chain from each coordinate ends is found by doubling jumps. ``leave[k]`` holds where the entering anchor reaches
    ``begin[k]`` and not ``begin[k + 1]``; ``begin[0]`` is not looked at.
    """
    n, here = len(x), np.arange(len(x))
    after = np.searchsorted(x, x + tol, side="right")
    while True:  # differences decide, not sums
        early = (after < n) & (x[np.minimum(after, n - 1)] - x <= tol)
        late = (after > here + 1) & (x[after - 1] - x > tol)
        if not early.any() and not late.any():
            break
        after = after + early - late
    end = np.where(after < n, after, here)
    while (end[end] != end).any():
        end = end[end]
    leave = x[end[: min(n, int(after[0]) + 1)]]  # an entering anchor is not beyond the first coordinate
    new = np.flatnonzero(np.concatenate([[True], leave[1:] != leave[:-1]]))
    return x[np.maximum(new - 1, 0)], leave[new]


def _passages(by: list[str], coord: str, tol: float):
    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, by):
            kind = table.column(coord).type
            x = table.column(coord).to_numpy()
            first = np.flatnonzero(starts([table.column(k) for k in by]))
            found = [(*_passage(x[i:j], tol), x[j - 1]) for i, j in zip(first, [*first[1:], len(x)])]
            cols = [table.column(k).take(pa.array(first)).combine_chunks() for k in by]
            cols += [pa.array([f[k].tolist() for f in found], pa.list_(kind)) for k in (0, 1)] + [pa.array([f[2] for f in found], kind)]
            yield pa.RecordBatch.from_arrays(cols, names=[*by, "_from", "_leave", "_last"])

    return passages


def _followed(keys: list[str], piece: str, tol: float):
    """The anchor that each piece is entered with; null for the first of a key."""

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor = None, None
        for b in batches:
            out = []
            for k in range(b.num_rows):  # a row a piece
                name = tuple(b.column(c)[k].as_py() for c in keys)
                if name != now:
                    now, anchor = name, None
                out.append(anchor)
                begin, leave = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("_from", "_leave"))
                if anchor is None:
                    anchor = leave[0].item()
                elif b.column("_last")[k].as_py() - anchor > tol:
                    anchor = leave[int((begin[1:] - anchor <= tol).sum())].item()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (*keys, piece)), pa.array(out, b.column("_last").type)], names=[*keys, piece, "_entry"])

    return followed


def nearest_column(x: Column, columns: Column, tol: float) -> Column:
    """Name of the nearest of ``columns`` (array of ``x, name``), the first of equals; null beyond ``tol``."""
    best = F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(c["x"] - x).alias("d"), i.alias("i"), c["name"].alias("name"))))
    return F.when(best["d"] <= tol, best["name"])


def dedupe_position(df: DataFrame, keys: list[str], x: Column, y: Column, text: Column, order: list[str]) -> DataFrame:
    """One row a rounded position: the first with a point in its text, else the first.

    Positions round half to even. Defined cases: null coordinates are a position; null texts have no point; of rows that
    repeat one stays; no rows give none.
    """
    rx, ry, dot, n = (spare(df, c) for c in ("rx", "ry", "dot", "n"))
    w = W.partitionBy(*keys, rx, ry).orderBy(F.desc(dot), *order)
    at = df.withColumns({rx: F.bround(x, 1), ry: F.bround(y, 1), dot: F.contains(text, F.lit("."))})
    return at.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).select(*df.columns)


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], coord: str, width: float) -> DataFrame:
    """Pairs with ``|difference| < width`` of columns suffixed ``_l`` and ``_r``: an equi join on buckets, not a product.

    Defined cases: null keys and coordinates pair with nothing, and with a width of 0 or less nothing does; repeated rows
    pair each; an empty side gives no pairs.
    """
    if width <= 0:
        left, width = left.limit(0), 1.0
    at = spare(left, spare(right, "band"))
    a = left.select(*[F.col(c).alias(c if c in keys else c + "_l") for c in left.columns]).withColumn(at, F.floor(F.col(coord + "_l") / width))
    b = right.select(*[F.col(c).alias(c if c in keys else c + "_r") for c in right.columns])
    b = b.withColumn(at, F.explode(F.array(*[F.floor(F.col(coord + "_r") / width) + d for d in (-1, 0, 1)])))
    return a.join(b, [*keys, at]).filter(F.abs(F.col(coord + "_l") - F.col(coord + "_r")) < width).drop(at)


def next_boundary(df: DataFrame, keys: list[str], order: list[str], at: Column, is_boundary: Column, out: str = "boundary") -> DataFrame:
    """Adds the least boundary after each row; null where none follows, or only null ones. Null keys are a group; no rows give none."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return df.withColumn(out, F.min(F.when(is_boundary, at)).over(w))


def pair_exclusive(df: DataFrame, key: str, coord: str, ident: str, kind: str, header: str, trigger: str, rows_each: int | None = ROWS_EACH) -> DataFrame:
    """Each header, in order, takes the nearest unused trigger above it, else the first unused one before the next header.

    Unused triggers are a stack, and a header that finds none waits until the next row. How high the stack is follows
    from counts alone: a trigger adds one, a header takes one, and below a waiting header it does not fall. So a key of more
    than ``rows_each`` rows is cut into pieces of its order; each tells by how much it moves the height and how low it would
    come, heights between pieces follow from running sums and maxima of these, and every piece then pairs its rows by
    itself. What a piece leaves open at a height is paired with the next that a later piece leaves open there.

    ``key, header_id, trigger_id`` (null: none left). With ``rows_each`` None no key is cut, and none is counted. Of several triggers at one height the first is taken.
    Defined cases: rows of another or no kind take no part; a header without a coordinate has no trigger, and a trigger
    without one is not used; null keys are a group; rows of one coordinate of a key are one task's; no rows give none.
    """
    one = df.schema[ident].dataType
    slim = df.filter(F.col(kind).isin(header, trigger)).select(F.col(key).alias("_key"), F.col(coord).alias("_at"), F.col(ident).alias("_id"), (F.col(kind) == trigger).alias("_below"))
    known = slim.filter("_at is not null")
    placed, many = (known.withColumn("_piece", F.lit(0)), False) if rows_each is None else cut(known, ["_key"], "_at", "_piece", rows_each)
    by = ["_key", "_piece"]
    # At one height headers come first: a trigger there is not above them.
    ordered = lambda x: x.repartition(*by).sortWithinPartitions(*by, "_at", "_below", "_id")
    if many:
        w = W.partitionBy("_key").orderBy("_piece")
        before = w.rowsBetween(W.unboundedPreceding, -1)
        moved = ordered(placed).mapInArrow(_heights, T.StructType([*placed.select(*by).schema.fields, T.StructField("_sum", T.LongType()), T.StructField("_low", T.LongType())]))
        moved = moved.withColumn("_upto", F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, 0)))
        entered = F.coalesce(F.sum("_sum").over(before), F.lit(0)) + F.greatest(F.lit(0), F.coalesce(F.max(F.col("_low") - F.col("_upto")).over(before), F.lit(0)))
        moved = moved.select(*by, entered.alias("_in"))
        placed = placed.join(moved, same(placed, moved, *by)).select(*[placed[c] for c in placed.columns], "_in")
    else:
        placed = placed.withColumn("_in", F.lit(0).cast("long"))
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("header_id", one), T.StructField("trigger_id", one), T.StructField("_level", T.LongType()), T.StructField("_piece", T.IntegerType())])
    found = ordered(placed).mapInArrow(_paired, schema)
    if many:
        # Open ends of one height: first what a piece takes from earlier ones, then what it leaves to later ones.
        ends = found.filter("_level is not null")
        w = W.partitionBy("_key", "_level").orderBy("_piece", F.col("header_id").isNull() == (F.col("_level") > 0))
        ends = ends.withColumn("trigger_id", F.when(F.col("_level") > 0, F.lag("trigger_id").over(w)).otherwise(F.lead("trigger_id").over(w)))
        found = found.filter("_level is null").unionByName(ends.filter("header_id is not null"))
    else:
        found = found.filter("header_id is not null")
    lost = slim.filter("_at is null and not _below").select("_key", F.col("_id").alias("header_id"), F.lit(None).cast(one).alias("trigger_id"))
    return found.select("_key", "header_id", "trigger_id").unionByName(lost).withColumnRenamed("_key", key)


def _walk(below: np.ndarray, first: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heights before and after each row of several groups (-1: a header waits), and the sums of steps as if nothing held them.

    ``first`` says where groups begin, ``entered`` is the height there, given for every row.
    """
    n, group = len(below), np.cumsum(first) - 1
    step = np.where(below, 1, -1)
    total = np.cumsum(step)
    free = total - (total - step)[first][group] + entered
    far = group * (4 * n + 4 * int(np.abs(entered).max(initial=0)) + 8)  # so that a later group's maximum starts anew
    after = free + np.maximum(0, np.maximum.accumulate(far - 1 - free) - far)
    return np.where(first, entered, np.concatenate([[0], after[:-1]])), after, free


def _heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the sum of its steps, and the least height that it can be left at."""
    for table in whole_groups(batches, ["_key", "_piece"]):
        first = starts([table.column("_key"), table.column("_piece")])
        _, _, free = _walk(table.column("_below").to_numpy(), first, np.zeros(len(first), np.int64))
        at = np.flatnonzero(first)
        total = free[np.concatenate([at[1:], [len(first)]]) - 1]
        low = total + np.maximum.reduceat(-1 - free, at)
        yield pa.RecordBatch.from_arrays([*(table.column(c).take(pa.array(at)).combine_chunks() for c in ("_key", "_piece")), pa.array(total), pa.array(low)], names=["_key", "_piece", "_sum", "_low"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within pieces, and open ends with their level: a stack's height, or -1 beside a waiting header."""
    for table in whole_groups(batches, ["_key", "_piece"]):
        below, n = table.column("_below").to_numpy(), table.num_rows
        first = starts([table.column("_key"), table.column("_piece")])
        group, here, entered = np.cumsum(first) - 1, np.arange(n), table.column("_in").to_numpy()
        before, after, _ = _walk(below, first, entered)
        pushed, popping = below & (before >= 0), ~below & (before >= 1)
        # The first of several triggers at one height is to be taken first: their places on the stack are turned round.
        new = starts([table.column("_at")]) | first | ~below | ~np.concatenate([[False], pushed[:-1]])
        begin, run = np.flatnonzero(new), np.cumsum(new) - 1
        told = np.where(pushed, begin[run] + np.concatenate([begin[1:], [n]])[run] - 1 - here, here)
        # At one height of the stack, rows that put a trigger there and rows that take it off take turns.
        level = np.where(pushed, after, before)
        rows = np.flatnonzero(pushed | popping)
        rows = rows[np.lexsort((rows, level[rows], group[rows]))]
        joined = (group[rows][1:] == group[rows][:-1]) & (level[rows][1:] == level[rows][:-1]) & pushed[rows][:-1]
        given, taker = rows[:-1][joined], rows[1:][joined]
        kept, short = np.setdiff1d(np.flatnonzero(pushed), given), np.setdiff1d(np.flatnonzero(popping), taker)
        waits, last = ~below & (before <= 0), np.concatenate([first[1:], [True]])
        now, late, answer = np.flatnonzero(waits & ~last), np.flatnonzero(waits & last), np.flatnonzero(first & (entered == -1))
        no = lambda *some: np.full(sum(map(len, some)), -1)
        head = np.concatenate([taker, now, short, late, no(kept, answer)])
        trig = np.concatenate([told[given], np.where(below[np.minimum(now + 1, n - 1)], now + 1, -1), no(short, late), told[kept], np.where(below[answer], answer, -1)])
        own = np.concatenate([taker, now, short, late, kept, answer])
        height = np.concatenate([no(taker, now), level[short], no(late), level[kept], no(answer)])
        pick = lambda c, k: table.column(c).take(pa.array(k, mask=k < 0)).combine_chunks()
        yield pa.RecordBatch.from_arrays([pick("_key", own), pick("_id", head), pick("_id", trig), pa.array(height, mask=np.arange(len(own)) < len(taker) + len(now)), pick("_piece", own)], names=["_key", "header_id", "trigger_id", "_level", "_piece"])


def pivot4(cells: DataFrame, keys: list[str], column: str, value: Column, order: list[str], names: list[str]) -> DataFrame:
    """The last value of each named column, and how many are there.

    Defined cases: a cell of another name is no column, and a group of such alone is a row of nulls; a null value that is
    last is null; null keys are a group; no rows give none.
    """
    last = lambda n: F.max_by(value, F.when(F.col(column) == n, F.struct(*order)))
    got = [F.when(F.max(F.col(column) == n), last(n)).alias(n) for n in names]
    out = cells.groupBy(*keys).agg(*got)
    return out.withColumn("n_cells", sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)))
