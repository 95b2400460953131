import difflib
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions import gestalt, match
from tabularium.functions import text as t

SCORES = [
    ("Winchester 308", "308 Winchester", 1.0),
    ("S&W 38", "38 Smith & Wesson", 1.0),
    ("7×57", "7x57", 1.0),
    ("9mm", "9MM", 1.0),
    ("9.3x62", "9.3x62mm", 1.0),
    ("223", "222", 0.0),
    ("7x57", "7mm Mauser (7x57mm)", 0.75 + 0.25 / 3),
    ("223 remington", "223 Remington (AR-15)", 0.95),
    ("223 remington", "6x45mm (223 Rem Case)", 0.875),
    ("223 remington", "223 Remington Handgun", 0.95),
    ("280 ackley", "280 Ackley Improved", 0.95),
    ("0.308", "308 Winchester", 0.0),
    ("45 acp", "45 Auto", 0.0),
]


def product(q, c, limit, least, use_ratio):
    """The best labels by scoring every query against every label."""
    a = q.dropDuplicates(["query_id", "text"]).select("query_id", "text", t.normal_tokens(F.col("text")).alias("qn"), t.raw_tokens(F.col("text")).alias("qr"))
    b = c.select("*", t.normal_tokens(F.col("label")).alias("cn"), t.raw_tokens(F.col("label")).alias("cr"))
    plain = F.udf(lambda x, y: None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio(), "double")
    own = plain(F.array_join("qn", " "), F.array_join("cn", " ")) if use_ratio else None
    w = W.partitionBy("query_id", "source").orderBy(F.desc("score"), "ord")
    every = a.crossJoin(b).withColumn("score", match.score(F.col("qn"), F.col("cn"), F.col("qr"), F.col("cr"), own))
    return every.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= limit) & (F.col("score") >= least))


@pytest.mark.parametrize(("query", "label", "want"), SCORES)
def test_score(spark, query, label, want):
    q = spark.createDataFrame([(0, query)], "query_id int, text string")
    c = spark.createDataFrame([("s", 0, label)], "source string, ord int, label string")
    assert product(q, c, 1, 0.0, True).first()["score"] == pytest.approx(want)
    assert [r["score"] for r in match.best_matches(q, c).collect()] == ([pytest.approx(want)] if want else [])


def names(rng, k):
    some = ["308", "223", "9mm", "0mm", "mm", "s", "w", "&", "s&w", "S & W", "rem", "mag", "ai", "40", "6.5", "x", "57", "brass", "polished", "ring", "small", "smal", "rinq", "steel", "9", "09mm", "winchester", "special", "a", "bc", "×"]
    return rng.choice([" ", "-", "  "]).join(rng.choice(some) for _ in range(k))


@pytest.mark.parametrize(("limit", "least", "use_ratio"), [(5, 0.45, True), (1, 0.45, True), (5, 0.45, False), (3, 0.8, True), (5, 0.2, False)])
def test_best_matches_are_those_of_the_product(spark, limit, least, use_ratio):
    """Odd names, nulls, empty and repeated ones; few pairs are compared, and no plan has a product."""
    rng = random.Random(4)
    labels = [(s, i, names(rng, rng.randrange(0, 6)), 1) for s in "uvw" for i in range(200)] + [("u", 900, None, 1), ("u", 901, "", 1), ("v", 900, "—", 1), ("v", 901, "9 9", 1), ("v", 902, "9mm", 1)]
    asked = [(i, names(rng, rng.randrange(0, 4))) for i in range(150)] + [(200, None), (201, ""), (202, "polishde rign"), (203, "smallring"), (204, "S&W 40"), (205, "s w"), (205, "s w"), (5, "ring"), (206, "9")]
    q, c = spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(labels, "source string, ord int, label string, score int")
    c = c.withColumnRenamed("score", "weight")
    told = lambda df: sorted(((r["query_id"], r["source"], r["rank"], r["ord"], round(r["score"], 9), r["weight"]) for r in df.collect()), key=str)
    got = match.best_matches(q, c, limit, least, use_ratio)
    assert told(got) == told(product(q, c, limit, least, use_ratio)) and got.columns == ["source", "ord", "label", "weight", "query_id", "text", "score", "rank"]
    assert match.candidates(q, c, limit, least, use_ratio).count() < len(labels) * len(asked) // 8
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
    assert match.best_matches(q.limit(0), c, limit, least, use_ratio).count() == match.best_matches(q, c.limit(0), limit, least, use_ratio).count() == 0


def test_a_thousand_phrases_against_all_names(spark, small):
    """Names cut short and misspelt, against the names, brands and sizes of all parts."""
    part = spark.read.parquet(f"{small}/part.parquet")
    c = part.select(F.lit("part").alias("source"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("label"))
    rng, labels = random.Random(6), [r["label"] for r in c.collect()]
    asked = []
    for k in range(1000):
        w = rng.choice(labels)
        i = rng.randrange(len(w))
        asked.append((k, rng.choice([w, w[:i] + w[i + 1 :], " ".join(w.split()[: rng.randrange(1, 4)]), w[:i] + "q" + w[i:], w.split()[rng.randrange(2)]])))
    q = spark.createDataFrame(asked, "query_id int, text string")
    told = lambda df: sorted((r["query_id"], r["rank"], r["ord"], round(r["score"], 9)) for r in df.collect())
    assert told(match.best_matches(q, c)) == told(product(q, c, 5, 0.45, True))


def test_ratios_of_many_pairs_are_the_plain_ones():
    rng = random.Random(2)
    text = lambda n, k: "".join(rng.choice("abcdefghij \U0001f600é"[:k]) for _ in range(n))
    a, b = ["", "a", ""], ["", "", "b"]
    for size, n in ((30, 2000), (400, 60)):
        for _ in range(n):
            k = rng.choice([2, 3, 5, 12])
            a.append(text(rng.randrange(size), k))
            b.append(text(rng.randrange(size), k) if rng.random() < 0.5 else text(9, 12) + a[-1][: size // 3] + text(rng.randrange(9), k) + a[-1][size // 4 :] + "xyz" * (size // 8))
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert gestalt.ratios(a, b).tolist() == want
    some = gestalt.ratios(a, b, np.full(len(a), 0.75)).tolist()
    assert all(g == w if w >= 0.75 else g in (0, w) for g, w in zip(some, want)) and gestalt.ratios([], []).tolist() == []


def test_ratio_is_gestalt_and_ordered(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select(match.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() if b is not None else None for a, b in pairs]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, t.without_link_note(F.col("a")), a="357 SIG- This link will open a PDF document") == "357 SIG"
    assert one(spark, t.name_before_weight(F.col("a")), a="30-06 Springfield 180") == "30-06 Springfield"
    assert one(spark, t.name_before_weight(F.col("a")), a="no number") == "no number"
    assert one(spark, F.struct(*t.value_and_flags(F.col("a"))), a="2870 c•") == (2870.0, "compressed, long drop tube")
    assert one(spark, F.struct(*t.value_and_flags(F.col("a"))), a="1.2.3") == (None, "")
    assert one(spark, t.split_lines(F.col("a")), a="a\r\nb\fc\n") == ["a", "b", "c"]
    assert one(spark, t.strip(F.col("a")), a="  x\t") == "x"
    assert one(spark, t.slug(F.col("a")), a="--!") == "query"
    assert one(spark, t.bullet_type(F.col("a")), a="115 Grain") == ""
    assert one(spark, F.transform(t.badges(F.col("a")), lambda b: b["kind"]), a="most accurate, compressed, x") == ["green", "amber", "plain"]
    charge = lambda **v: one(spark, t.charge_display(F.col("a").try_cast("double"), F.col("b").try_cast("double"), F.col("c").try_cast("double"), F.lit(True)), **{k: str(x) for k, x in v.items()})
    assert [charge(a=30.5, b=1.0, c=2.5), charge(a=30.0, b=1.0, c=""), charge(a="", b=1.0, c=""), charge(a="", b="", c=2.0)] == ["1–2.5 gr", "30 gr (MAX)", "1 gr (start)", "—"]
    assert one(spark, t.velocity_display(F.col("a"), F.col("b")), a=2700.0, b=2500.5) == "2500.5–2700 fps"


def test_best_matches_limits_first(spark):
    q = spark.createDataFrame([(0, "223 remington")], "query_id int, text string")
    c = spark.createDataFrame([("s", 0, "223 Remington"), ("s", 1, "223 Rem"), ("s", 2, "222 Remington"), ("u", 0, "x")], "source string, ord int, label string")
    assert [(r["source"], r["ord"]) for r in match.best_matches(q, c, limit=1).collect()] == [("s", 0)]


def test_numbers_as_g(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 100000.0, 999999.0, 999999.4, 999999.6, 1e6, 1234567.0, 0.0001, 0.00009999, 1e-5, -2.5, 30.10, 1e300, -1e-300, 12345.678, float("inf"), float("-inf"), float("nan")]
    xs += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 9) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate([*xs, None])], "k int, x double").select(t.display_g(F.col("x")), "k").orderBy("k").collect()]
    assert [g.replace("-0", "0") if x == 0 else g for g, x in zip(got, xs)] == [f"{x:g}".replace("-0", "0") if x == 0 else f"{x:g}" for x in xs] and got[-1] is None
