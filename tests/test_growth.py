"""Plans whose work stays spread over tasks as tables grow."""

import pytest
from pyspark.sql import functions as F

from tabularium.operators.geometry import cluster_anchored, gathered_clusters
from tabularium.plans import catalogue, printed


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_print_is_dealt_out_by_document(spark, small, monkeypatch):
    """One narrow file is printed by as many tasks as exchanges have, and by more where parts are more; no document is in two."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert printed.facts(spark, small).rdd.getNumPartitions() == least
    monkeypatch.setattr(printed, "PARTS_EACH", 9)
    f = printed.facts(spark, small)
    assert f.rdd.getNumPartitions() == -(-f.count() // 9) > least
    assert f.select("doc_id", F.spark_partition_id().alias("p")).distinct().groupBy("doc_id").count().filter("count > 1").count() == 0


def test_words_of_sections_are_not_sent_whole(spark, small):
    """A print of few bytes is many words: it is neither broadcast, nor computed for what cannot be there."""
    plan = planned(printed.extract_sections(spark, small))
    assert "BroadcastHashJoin" not in plan and plan.count("Generate explode(filter(array(") == 2


@pytest.mark.parametrize("name", ["extract_grid", "extract_recipes"])
def test_words_of_pages_are_not_sent_whole(name, spark, small):
    """Three prints at most (rows, what stands above them, the first page), joined without broadcasts."""
    plan = planned(catalogue.QUERIES[name](spark, small))
    assert "BroadcastHashJoin" not in plan and plan.count("Generate explode(filter(array(") <= 3


def test_recipe_pages_are_gathered_once(spark, small):
    """One print of the words, which leave neither their task nor the JVM; parts are dealt out once for each of words, lines and documents."""
    plan = planned(printed.extract_recipes(spark, small))
    assert plan.count("Generate explode(filter(array(") == 1 and "MapInArrow" not in plan and plan.count("Exchange") == 3


def test_gathered_clusters_are_the_streamed_ones(spark):
    """Anchors do not chain; coordinates at the very tolerance, equal, missing or not numbers, pages without any, whole numbers."""
    inf, nan = float("inf"), float("nan")
    pages = {"a": [1.0, 3.0, 3.1, 5.0, 5.1, 7.2, 1.0], "b": [None, 4.0, None, 9.0], "c": [None], "d": [nan, 2.0, 1.0], "e": [inf, inf, -inf, 0.0], "f": [0.1 * k for k in range(90, 0, -1)], "g": [nan]}
    df = spark.createDataFrame([(k, i, x) for k, xs in pages.items() for i, x in enumerate(xs)], "k string, i int, x double")
    for kind in ("double", "int"):
        one = df if kind == "double" else df.filter("x > -1e9 and x < 1e9").withColumn("x", F.col("x").cast(kind))
        got = one.groupBy("k").agg(F.collect_list(F.struct("i", "x")).alias("at")).select("k", F.explode(gathered_clusters(F.col("at"), "x", 2.0)).alias("c")).select("k", "c.anchor", F.explode("c.items").alias("w")).select("k", "w.i", "anchor")
        want = cluster_anchored(one, ["k"], "x", 2.0).filter("x is not null").select("k", "i", "anchor")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        gathered_clusters(F.col("at"), "x", -1.0)


def test_clusters_read_their_input_once(spark):
    """Rows without a coordinate are no second computation; rows that lie together are not dealt out again."""
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.5), ("a", 4.0), (None, 3.0), ("b", None), ("b", 9.0), (None, None), ("b", 10.0)], "k string, x double")
    got = cluster_anchored(df.repartition(3, "k"), ["k"], "x", 2.0)
    assert planned(got).count("Exchange") == 1 and "Union" not in planned(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1.0, 1.0), ("a", None, None), ("a", 2.5, 1.0), ("a", 4.0, 4.0), (None, 3.0, 3.0), ("b", None, None), ("b", 9.0, 9.0), (None, None, None), ("b", 10.0, 9.0)], key=str)


def test_orders_are_dealt_out_by_rows(spark, small, monkeypatch, same_as_sql):
    """Lines are sorted and counted in as many tasks as they fill, with the twin's rows."""
    n = catalogue.read(spark, small, "lineitem").count()
    monkeypatch.setattr(catalogue, "LINES_EACH", n // 20)
    assert catalogue.grid_unpivot_max(spark, small).rdd.getNumPartitions() == -(-n // (n // 20)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got, want = same_as_sql(catalogue.grid_unpivot_max, catalogue.ORACLES["grid_unpivot_max"])
    assert got == want and got


def test_labels_are_matched_once(spark, monkeypatch):
    """Of many entries of one label one is compared, the first (nulls are before all), and no source without documents is read."""
    from tabularium.plans import lookup

    seen, read = [], []
    best_matches = lookup.best_matches
    monkeypatch.setattr(lookup, "best_matches", lambda asked, listing, **k: seen.append(listing) or best_matches(asked, listing, **k))
    for name, p in list(lookup.PUBLISHERS.items()):
        monkeypatch.setitem(lookup.PUBLISHERS, name, lookup.Publisher(p.name, lambda s, d, name=name, p=p: read.append(name) or p.read(s, d), p.nothing))
    listing = spark.createDataFrame([("nosler", k, f"Round {k % 3}", "u", None) for k in range(30)] + [("hammer", 5, "Round 1", "u", None), ("hammer", None, "Round 1", "v", None)], lookup.LISTING)
    docs = spark.createDataFrame([("d", "nosler", 1, "Round 1", "", "u", "document", None), ("e", "hammer", None, "Round 1", "", "u", "document", "HTTP 500")], lookup.HARVEST_DOCS)
    empty = {n: spark.createDataFrame([], lookup.SCHEMAS[n]) for n in ("lines", "words", "sheet_rows")}
    found = lookup.lookup_many(lookup.Shelf(listing, docs, **empty), spark.createDataFrame([(1, "Round 1")], "query_id int, text string"))
    assert sorted(((r["source"], r["label"], r["ord"]) for r in seen[0].collect()), key=str) == [("hammer", "Round 1", None), *[("nosler", f"Round {k}", k) for k in range(3)]]
    assert read == ["nosler"] and found.results.count() == 5


def test_labels_are_prepared_only_as_queries_need(spark):
    """Labels are ranked for queries of one token alone, and none is left out whose length allows the least ratio."""
    from tabularium.functions import match

    listing = spark.createDataFrame([("s", k, f"Round {k}") for k in range(9)], "source string, ord bigint, label string")
    of = lambda text: planned(match.candidates(spark.createDataFrame([(0, text)], "query_id int, text string"), listing, use_ratio=False))
    assert "Window" not in of("Round 7") and "Window" in of("Round")
    sizes = spark.range(1, 80).selectExpr("cast(id as int) as s").crossJoin(spark.range(1, 40).selectExpr("cast(id as int) as o"))
    for least in (0.75, 0.8, 1.0):
        pairs = sizes.filter(2 * F.least("s", "o") >= least * (F.col("s") + F.col("o")) - 1e-9)
        for low, high in ((7, 7), (3, 12), (1, 39)):
            assert pairs.filter(F.col("o").between(low, high) & ~match._long_enough(F.col("s"), low, high, least)).count() == 0
        assert sizes.filter(match._long_enough(F.col("s"), 7, 7, least)).select(F.max("s")).first()[0] == int(7 * (2 - least) / least + 1e-6)


@pytest.mark.parametrize("sent", [0, 10])
def test_contents_are_made_of_asked_documents_alone(sent, spark, monkeypatch):
    """Labels are dealt out before they are tokenised, and contents that a function makes are made of what is looked up."""
    from tabularium.plans import lookup
    from tabularium.sources import publishers

    seen, labels, best_matches = [], [], lookup.best_matches
    monkeypatch.setattr(lookup, "best_matches", lambda asked, listing, **k: labels.append(listing) or best_matches(asked, listing, **k))
    monkeypatch.setattr(lookup, "DOCS_SENT", sent)
    monkeypatch.setattr(lookup, "LABELS_EACH", 3)
    texts = spark.createDataFrame([(d, f"Powder {d}      30.0   MAX.   2500   99   98%") for d in "def"], "doc_id string, value string")
    listing = spark.createDataFrame([("nosler", k, f"Round {k}", "u", None) for k in range(40)], lookup.LISTING)
    docs = spark.createDataFrame([("d", "nosler", 1, "Round 1", "", "u", "document", None), ("e", "nosler", 2, "Round 2", "", "u", "document", None)], lookup.HARVEST_DOCS)
    made = lambda only: seen.append(only(texts)) or publishers.text_lines(only(texts))
    empty = {n: spark.createDataFrame([], lookup.SCHEMAS[n]) for n in ("words", "sheet_rows")}
    shelf = lookup.Shelf(listing, docs, made, **empty)
    for found in (lookup.lookup(shelf, "Round 1"), lookup.lookup_many(shelf, spark.createDataFrame([(1, "Round 1")], "query_id int, text string"))):
        assert [(r["doc_id"], r["powder"]) for r in found.lines.collect()] == [("d", "Powder d")]
        assert [r["doc_id"] for r in seen[-1].collect()] == ["d"] and labels[-1].rdd.getNumPartitions() == 14
