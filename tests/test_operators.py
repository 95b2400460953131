import random

import pytest
from pyspark.sql import functions as F

from tabularium.operators import geometry, pieces, sequence


def test_anchors_do_not_chain(spark):
    rows = [("d", x) for x in (0.0, 2.0, 3.0, 4.0, 5.0, 8.1)] + [("e", 1.0), ("e", 4.0)]
    got = geometry.cluster_anchored(spark.createDataFrame(rows, "doc string, top double"), ["doc"], "top", 3.0).collect()
    assert sorted((r["doc"], r["top"], r["anchor"]) for r in got) == [("d", 0.0, 0.0), ("d", 2.0, 0.0), ("d", 3.0, 0.0), ("d", 4.0, 4.0), ("d", 5.0, 4.0), ("d", 8.1, 8.1), ("e", 1.0, 1.0), ("e", 4.0, 1.0)]


def test_nearest_column_ties_and_tolerance(spark):
    cols = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for x, n in ((10.0, "a"), (20.0, "b"))])
    got = spark.createDataFrame([(15.0,), (25.0,), (25.1,)], "x double").select(geometry.nearest_column(F.col("x"), cols, 5.0).alias("c")).collect()
    assert [r["c"] for r in got] == ["a", "b", None]


def test_pairs_are_exclusive(spark):
    rows = [("d", 1, 5.0, "h"), ("d", 2, 6.0, "t"), ("d", 3, 10.0, "h"), ("d", 4, 12.0, "h"), ("d", 5, 12.0, "t"), ("d", 6, 20.0, "h")]
    got = geometry.pair_exclusive(spark.createDataFrame(rows, "doc string, id long, top double, kind string"), "doc", "top", "id", "kind", "h", "t").collect()
    assert sorted((r["header_id"], r["trigger_id"]) for r in got) == [(1, 2), (3, None), (4, 5), (6, None)]


def test_pairs_take_the_first_of_one_height(spark):
    rows = [("d", 1, 5.0, "t"), ("d", 2, 5.0, "t"), ("d", 3, 6.0, "h"), ("d", 4, 7.0, "h")]
    got = geometry.pair_exclusive(spark.createDataFrame(rows, "doc string, id long, top double, kind string"), "doc", "top", "id", "kind", "h", "t").collect()
    assert sorted((r["header_id"], r["trigger_id"]) for r in got) == [(3, 1), (4, 2)]


def plain_pairs(rows):
    """By the definition: for each header in order, every unused trigger is looked at."""
    out = []
    for doc in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[2], r[1]))
        heads, free = [r for r in mine if r[3] == "h"], [r for r in mine if r[3] == "t"]
        for n, h in enumerate(heads):
            end = heads[n + 1][2] if n + 1 < len(heads) else float("inf")
            above = [t for t in free if t[2] < h[2]]
            below = [t for t in free if h[2] <= t[2] < end]
            taken = min(above, key=lambda t: (-t[2], t[1])) if above else below[0] if below else None
            if taken:
                free.remove(taken)
            out.append((doc, h[1], taken[1] if taken else None))
    return out


def test_pairs_in_a_stream_are_those_of_the_definition(spark):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(6)}", k, float(rng.randrange(60)), rng.choice("htx")) for k in range(600)]
    got = geometry.pair_exclusive(spark.createDataFrame(rows, "doc string, id long, top double, kind string"), "doc", "top", "id", "kind", "h", "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_pairs(rows), key=str)
    assert geometry.pair_exclusive(spark.createDataFrame([], "doc string, id long, top double, kind string"), "doc", "top", "id", "kind", "h", "t").count() == 0


def test_dedupe_prefers_the_point_and_first(spark):
    rows = [("455", 1.0, 2.0, 0), ("45.5", 1.0, 2.0, 1), ("45.6", 1.0, 2.0, 2), ("7", 3.0, 2.0, 3)]
    df = spark.createDataFrame(rows, "text string, x double, y double, seq int")
    got = geometry.dedupe_position(df, [], F.col("x"), F.col("y"), F.col("text"), ["seq"]).collect()
    assert sorted(r["text"] for r in got) == ["45.5", "7"]


def test_band_is_strict(spark):
    a = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 2.9), ("d", 3, 3.0), ("e", 4, 0.5)], "doc string, id int, top double")
    got = geometry.band_pairs(a, a, ["doc"], "top", 3.0).filter("id_l < id_r").collect()
    assert sorted((r["id_l"], r["id_r"]) for r in got) == [(1, 2), (2, 3)]


def test_pivot_takes_the_last(spark):
    rows = [("r", "a", 1.0, 0), ("r", "a", 2.0, 1), ("r", "b", 3.0, 2), ("s", "z", 1.0, 3)]
    got = {r["k"]: r for r in geometry.pivot4(spark.createDataFrame(rows, "k string, c string, v double, o int"), ["k"], "c", F.col("v"), ["o"], ["a", "b"]).collect()}
    assert (got["r"]["a"], got["r"]["b"], got["r"]["n_cells"], got["s"]["n_cells"]) == (2.0, 3.0, 2, 0)


def test_last_in_group(spark):
    df = spark.createDataFrame([("g", 1.0, 0), ("g", 2.0, 1), ("g", 2.0, 2)], "g string, v double, o int")
    got = df.select("o", sequence.last_in_group(["g"], [F.desc("v"), F.desc("o")]).alias("m")).filter("m").collect()
    assert [r["o"] for r in got] == [2]


def test_clusters_of_nulls_ties_and_islands(spark):
    """Null coordinates and keys, repeated rows, empty tables, clashing names; islands give what one task a group gives."""
    import random

    rng = random.Random(1)
    rows = [(k, x, 7, "s") for k in ("a", None, "b") for x in [None, 0, 0, *(rng.randrange(400) for _ in range(60))]]
    df = spark.createDataFrame(rows, "k string, x long, island int, stretch string")
    want = []
    for k in ("a", None, "b"):
        anchor = None
        for x in sorted(r[1] for r in rows if r[0] == k and r[1] is not None):
            if anchor is None or x - anchor > 5:
                anchor = x
            want.append((k, x, 7, "s", anchor))
        want.append((k, None, 7, "s", None))
    key = lambda r: tuple((v is not None, v) if v is not None else (False, 0) for v in r)
    for split in (False, True):
        out = geometry.cluster_anchored(df, ["k"], "x", 5, split=split)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == ["k", "x", "island", "stretch", "anchor"]
        assert sorted(got, key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
        assert geometry.cluster_anchored(df.limit(0), ["k"], "x", 5, split=split).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("k", 1.04, 2.0, "5", 1, 2, 3, 4, 5), ("k", 1.01, 2.0, "5.0", 1, 2, 3, 4, 5)], "k string, x double, y double, t string, rx int, ry int, n int, dot int, band int")
    (r,) = geometry.dedupe_position(df, ["k"], F.col("x"), F.col("y"), F.col("t"), ["x"]).collect()
    assert tuple(r) == ("k", 1.01, 2.0, "5.0", 1, 2, 3, 4, 5)
    pairs = geometry.band_pairs(df, df, ["k"], "x", 0.5)
    assert pairs.count() == 4 and "band_l" in pairs.columns


def test_bands_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("a", None, 2), (None, 1.0, 3), ("a", 1.4, 4), ("a", 1.5, 5)], "k string, x double, id int")
    got = sorted((r["id_l"], r["id_r"]) for r in geometry.band_pairs(df, df, ["k"], "x", 0.5).collect())
    assert got == sorted([(1, 1)] * 4 + [(1, 4), (4, 1)] * 2 + [(4, 4), (4, 5), (5, 4), (5, 5)])
    assert geometry.band_pairs(df.limit(0), df, ["k"], "x", 0.5).count() == 0


def test_positions_boundaries_and_pivots_of_nulls(spark):
    df = spark.createDataFrame([("a", None, None, None, 1), ("a", None, None, "5.", 2), ("a", 0.25, 0.0, "x", 3), ("a", 0.2, 0.0, "x", 4)], "k string, x double, y double, t string, id int")
    assert sorted(r["id"] for r in geometry.dedupe_position(df, ["k"], F.col("x"), F.col("y"), F.col("t"), ["id"]).collect()) == [2, 3]
    out = geometry.next_boundary(df, ["k"], ["id"], F.col("x"), F.col("id") > 1)
    assert [r["boundary"] for r in out.orderBy("id").collect()] == [0.2, 0.2, 0.2, None]
    cells = spark.createDataFrame([(None, "p", 1.0, 1), (None, "p", None, 2), (None, "q", 3.0, 1), ("z", "other", 1.0, 1)], "k string, c string, v double, o int")
    assert sorted((str(r["k"]), r["p"], r["q"], r["n_cells"]) for r in geometry.pivot4(cells, ["k"], "c", F.col("v"), ["o"], ["p", "q"]).collect()) == [("None", None, 3.0, 1), ("z", None, None, 0)]
    assert geometry.pivot4(cells.limit(0), ["k"], "c", F.col("v"), ["o"], ["p", "q"]).count() == 0


def test_sequences_of_nulls_and_clashing_names(spark):
    rows = [(None, 1, "META", "m1"), (None, 2, "BULLET", "b1"), (None, 3, "BULLET", "b2"), (None, 4, "HEADER", "h"), (None, 5, "DATA", "d1"), (None, 6, "odd", "x"), (None, 7, None, None), (None, 8, "DATA", "d2"), (None, 9, "META", None), (None, 10, "DATA", "d3"), ("k", 1, "HEADER", "h"), ("k", 2, "DATA", "d4")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "i", "t") for r in rows], "k string, o int, kind string, said string, seg int, active int, first int, table_id int, item string, meta string")
    out = sequence.sheet_islands(df, ["k"], "o", F.col("kind"), F.col("said"), F.col("said"))
    assert sorted((r["said"], r["item"], r["meta"], r["table_id"], r["seg"], r["first"]) for r in out.collect()) == [("d1", "b1", "m1", 1, 1, 3), ("d2", "b1", "m1", 1, 1, 3), ("d4", None, None, 1, 1, 3)]
    assert sequence.sheet_islands(df.limit(0), ["k"], "o", F.col("kind"), F.col("said"), F.col("said")).count() == 0
    carried = sequence.forward_fill_if(df, ["k"], ["o"], F.col("said"), F.col("kind").isin("META", "HEADER"), "c")
    assert [r["c"] for r in carried.filter("k is null").orderBy("o").collect()] == ["m1", "m1", "m1", "h", "h", "h", "h", "h", "h", "h"]


def test_pieces_of_a_key_pair_as_the_whole(spark):
    """Keys cut into pieces of few rows, one row each included, nulls of every column, and names that clash."""
    rng = random.Random(3)
    for kinds in ("htx", "hhhtx", "tttthx"):
        rows = [(rng.choice(["d0", "d0", "d1", None]), k, float(rng.randrange(50)), rng.choice(kinds), 0, 1) for k in range(500)]
        df = spark.createDataFrame([*rows, ("d0", 900, None, "h", 0, 1), ("d0", 901, None, "t", 0, 1), ("d0", 902, 3.0, None, 0, 1)], "doc string, id long, top double, kind string, _piece int, _in int")
        want = sorted([*plain_pairs([(r[0] or "None", *r[1:4]) for r in rows]), ("d0", 900, None)], key=str)
        for each in (10**6, 60, 7, 1):
            got = geometry.pair_exclusive(df, "doc", "top", "id", "kind", "h", "t", rows_each=each)
            assert got.columns == ["doc", "header_id", "trigger_id"]
            assert sorted(((r["doc"] or "None", r["header_id"], r["trigger_id"]) for r in got.collect()), key=str) == want


def test_one_key_of_many_rows_is_many_tasks(spark):
    """All rows under one key: no task has more than a small share of them, for pairs and for clusters without a gap."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") * 7919 % 200_003).cast("double").alias("x"), F.when(F.xxhash64("id") % 3 == 0, "h").otherwise("t").alias("kind"))
    for rows_each, parts in ((10_000, 20),):
        placed, many = pieces.cut(df, ["k"], "x", "piece", rows_each)
        sizes = [r["count"] for r in placed.groupBy("piece").count().collect()]
        assert many and len(sizes) == parts and max(sizes) < 1.2 * rows_each
    whole = geometry.pair_exclusive(df, "k", "x", "id", "kind", "h", "t")
    assert whole.exceptAll(geometry.pair_exclusive(df, "k", "x", "id", "kind", "h", "t", rows_each=20_000)).count() == 0 and whole.count() == df.filter("kind = 'h'").count()
    one = geometry.cluster_anchored(df, ["k"], "x", 2.5)
    cut = geometry.cluster_anchored(df, ["k"], "x", 2.5, split=True, rows_each=20_000)
    assert one.exceptAll(cut).count() == 0 and cut.count() == 200_000


def test_clusters_of_pieces_are_those_of_the_stream(spark):
    """Any tolerance, 0 included, integers and fractions, with and without keys."""
    rng = random.Random(2)
    rows = [("a", rng.randrange(2000) / rng.choice([1, 2, 10])) for _ in range(700)] + [(k, float(rng.randrange(60))) for k in ("b", None) for _ in range(200)] + [("a", None)] * 3
    df = spark.createDataFrame(rows, "k string, x double")

    def plain(keyed, tol):
        want = [(k, None, None) for k, x in rows if x is None]
        for key in {k if keyed else 0 for k, _ in rows}:
            anchor = None
            for x, k in sorted(((x, k) for k, x in rows if x is not None and (k if keyed else 0) == key), key=lambda r: (r[0], str(r[1]))):
                anchor = x if anchor is None or x - anchor > tol else anchor
                want.append((k, x, anchor))
        return sorted(want, key=str)

    for tol in (0.0, 0.35, 25.0, 4000.0):
        for keys in (["k"], []):
            for split, each in ((False, 1), (True, 100), (True, 9)):
                assert sorted(map(tuple, geometry.cluster_anchored(df, keys, "x", tol, split=split, rows_each=each).collect()), key=str) == plain(bool(keys), tol), (tol, keys, each)
    with pytest.raises(ValueError, match="negative"):
        geometry.cluster_anchored(df, ["k"], "x", -1.0)


def test_bands_of_no_width(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, x double")
    assert geometry.band_pairs(df, df, ["k"], "x", 0.0).count() == 0
