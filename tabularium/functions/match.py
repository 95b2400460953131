"""Scores of a query against a candidate name, and the best candidates of each source.

Candidates come from indexes over the labels, never from a product. A label scores
the least that is asked for in one of three ways, each with an index of its own:

* it holds all tokens of the query: found by the rarest of these. For a query of one
  token only the first ``limit`` labels of each way to rank are kept of a token.
* its tokens begin with the query's in order though it does not hold them all in
  their normal form (an "s & w" that is joined, a lone unit): found by the first token.
* its letters are alike. Of letters in common, blocks of ``n`` hold ``n - 1`` pairs of
  neighbouring letters, and there are no more blocks than letters not in common and one,
  so at a ratio of ``r`` at least ``(1.5 r - 1) (|a| + |b|) - 1`` pairs are shared. Ordered by
  how rare they are, two strings then share a pair among the first of each, and are compared at
  the first such pair alone. Strings too short to share a pair for sure are found by their rarest letters.

Where a query has ``limit`` labels of a source by tokens, letters are compared only where they may reach the last of these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabularium.functions.gestalt import ratios
from tabularium.functions.text import normal_tokens, raw_tokens

LEAST_RATIO = 0.75
PREFIX_BONUS, PREFIX_CEILING = 0.3, 0.95
LIMIT, LEAST_SCORE = 5, 0.45


def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, least in pairs:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[known] = ratios(a[known].tolist(), b[known].tolist(), least[known].fillna(0.0).to_numpy(float))
        yield pd.Series(out).astype(object).where(known, None).astype("Float64")


def ratio(a: Column, b: Column, least: Column | None = None) -> Column:
    """Gestalt similarity of two strings in this order, null beside a null; may be 0 where letters allow less than ``least``."""
    return F.pandas_udf(_ratio, T.DoubleType())(a, b, F.lit(0.0) if least is None else least)


def _digits(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.rlike(t, F.lit("^[0-9]+$")))


def _starts(q_raw: Column, c_raw: Column) -> Column:
    return (F.size(q_raw) > 0) & (F.slice(c_raw, F.lit(1), F.greatest(F.size(q_raw), F.lit(1))) == q_raw)


def score(q_norm: Column, c_norm: Column, q_raw: Column, c_raw: Column, character_ratio: Column | None) -> Column:
    """From token arrays, normal and raw. ``character_ratio`` is of the joined normal tokens; None: 0."""
    guard = F.size(F.array_except(_digits(q_norm), c_norm)) > 0
    q_set, c_set = F.array_distinct(q_norm), F.array_distinct(c_norm)
    inside = (F.size(q_set) > 0) & (F.size(F.array_except(q_set, c_set)) == 0)
    share = F.lit(0.75) + F.lit(0.25) * F.size(q_set) / F.greatest(F.size(c_set), F.lit(1))
    loose = F.lit(0.0) if character_ratio is None else F.when(character_ratio >= LEAST_RATIO, character_ratio).otherwise(0.0)
    base = F.when(inside, share).otherwise(loose)
    lifted = F.when(_starts(q_raw, c_raw), F.least(F.lit(PREFIX_CEILING), base + PREFIX_BONUS)).otherwise(base)
    return F.when(F.array_join(q_norm, " ") == F.array_join(c_norm, " "), 1.0).when(guard, 0.0).otherwise(lifted)


def _own_score(character_ratio: Column | None) -> Column:
    return score(F.col("_qn"), F.col("_cn"), F.col("_qr"), F.col("_cr"), character_ratio)


def _or_empty(tokens: Column) -> Column:
    """Tokens to be joined on; a name without any is found by the empty one."""
    return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(tokens)


def _single() -> Column:
    """Whether a query is of one token."""
    return (F.size("_qs") <= 1) & (F.size("_qr") == 1)


def _held(q: DataFrame, c: DataFrame, limit: int, some_single: bool) -> DataFrame:
    """Pairs whose label holds every token of the query; of one-token queries, if there are some, those that can be among the ``limit`` best."""
    posts = c.withColumn("_t", F.explode(_or_empty(F.col("_cs")))).withColumn("_first", F.get("_cr", F.lit(0)))
    counts = c.select(F.explode(_or_empty(F.col("_cs"))).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    asked = q.withColumn("_t", F.explode(_or_empty(F.col("_qs")))).join(counts, "_t", "left")
    rare = asked.groupBy("query_id", "text").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), F.col("_t"))).alias("_rare"), *[F.first(x).alias(x) for x in ("_qn", "_qr", "_qs", "_q")])
    rare = rare.select("query_id", "text", "_qn", "_qr", "_qs", "_q", F.col("_rare._t").alias("_t"))
    one, many = rare.filter(_single()), rare.filter(~_single())
    holds = F.size(F.array_except("_qs", "_cs")) == 0
    all_held = posts.join(many, "_t").filter(holds).drop("_t", "_first")
    if not some_single:
        return all_held
    best = lambda keys, *order: posts.withColumn("_rank", F.row_number().over(W.partitionBy("source", *keys).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")
    # A label that begins with the token scores more than any that does not, but for those of that token alone.
    begun = best(["_t", "_first"], F.col("_c") != F.col("_t"), "ord").withColumnRenamed("_first", "_begin").join(one.withColumn("_begin", F.get("_qr", F.lit(0))), ["_t", "_begin"]).drop("_begin")
    inside = best(["_t", F.when(F.size("_cs") <= 1, F.col("_first"))], F.size("_cs"), "ord").join(one, "_t").filter(~F.coalesce(F.col("_first") == F.get("_qr", F.lit(0)), F.lit(False)))
    return reduce(DataFrame.unionByName, [all_held, *[x.drop("_t", "_first") for x in (begun, inside)]])


#: Tokens of which a normal form can differ from the raw one by what stands beside them.
_TURNED = ("s", "mm")


def _turned() -> Column:
    """Whether a query has a token whose normal form can differ by what stands beside it."""
    return F.coalesce(F.arrays_overlap("_qr", F.array(*map(F.lit, _TURNED))), F.lit(False))


def _begun(q: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs whose label begins with the query's raw tokens but lacks a normal one."""
    odd = q.filter(_turned()).withColumn("_first", F.get("_qr", F.lit(0)))
    both = c.withColumn("_first", F.get("_cr", F.lit(0))).join(odd, "_first").drop("_first")
    return both.filter(_starts(F.col("_qr"), F.col("_cr")) & (F.size(F.array_except("_qs", "_cs")) > 0))


def _rarest(grams: Column, counts: dict[str, int], n: Column) -> Column:
    """The ``n`` rarest of ``grams`` by the counts, the rarest first."""
    table = F.from_json(F.lit(json.dumps(counts)), "map<string,int>")
    told = F.array_sort(F.transform(grams, lambda g: F.struct(F.coalesce(F.try_element_at(table, g), F.lit(0)).alias("n"), g.alias("g"))))
    return F.transform(F.slice(told, F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda x: x["g"])


def _letters(s: Column, width: int) -> Column:
    """Runs of ``width`` letters, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (width - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(width))))


#: Up to this length two strings of ``LEAST_RATIO`` may share no pair of letters.
SHORT = 9


def _long_enough(size: Column, shortest: int, longest: int, least: float) -> Column:
    """Whether a label of ``size`` letters can be alike to a query of some length between these."""
    return (size >= least * shortest / (2.0 - least) - 1e-6) & (size <= (2.0 - least) * longest / least + 1e-6)


def _alike(q: DataFrame, c: DataFrame, least: float, wanted: dict[int, tuple[int, int]], grams: dict[str, int]) -> DataFrame:
    """Pairs whose letters may be alike to ``least``: a query of more than ``SHORT`` letters by pairs of letters, others by letters.

    ``wanted`` are the lengths of runs, 2 and 1, for which there are queries, with these queries' least and greatest length;
    ``grams`` has the counts of both. Labels that are too short or too long for all queries are left out first.

    ``q`` has a least ratio of its own in ``_least``. The letters of tokens are few, so the counts are a table of bounded size.
    """
    size, own = F.length("_c"), F.length("_q")
    least_other = lambda n, r: n * 2.0 / (2.0 - r)  # noqa: E731, letters of both at the least
    kept = []
    sides = {2: (q.filter(own > SHORT), c.filter(size > 1)), 1: (q.filter((own <= SHORT) & (own > 0)), c.filter((size > 0) & (size <= int(SHORT * (2 - least) / least))))}
    for width in wanted:
        part, labels = sides[width]
        labels = labels.filter(_long_enough(size, *wanted[width], least))
        posts = labels.withColumn("_grams", _letters(F.col("_c"), width))
        counts = {g: n for g, n in grams.items() if len(g) == width}
        if width == 2:  # so many pairs of letters are shared at least
            shared = lambda n, r: F.greatest(F.ceil((1.5 * r - 1.0) * least_other(n, r) - 1.0 - 1e-9), F.lit(1))
        else:
            shared = lambda n, r: F.ceil(r * least_other(n, r) / 2.0 - 1e-9)
        # A run of letters that stands twice counts once here, so that a short list keeps one more.
        first = lambda n, r: n - (width - 1) - shared(n, r) + 1
        posts = posts.withColumn("_cg", _rarest(F.col("_grams"), counts, first(size, F.lit(least)))).drop("_grams").withColumn("_g", F.explode("_cg"))
        part = part.withColumn("_qg", _rarest(_letters(F.col("_q"), width), counts, first(own, F.col("_least")))).withColumn("_g", F.explode("_qg"))
        met = posts.join(part, "_g").filter(F.get(F.array_intersect("_qg", "_cg"), F.lit(0)) == F.col("_g"))
        kept.append(met.drop("_g", "_qg", "_cg"))
    both = reduce(DataFrame.unionByName, kept)
    apart = (F.size(F.array_except("_qs", "_cs")) > 0) & ~_starts(F.col("_qr"), F.col("_cr")) & (F.size(F.array_except(_digits(F.col("_qn")), "_cn")) == 0)
    return both.filter(apart & (2 * F.least(size, own) >= F.col("_least") * (size + own) - 1e-9))


def candidates(queries: DataFrame, listing: DataFrame, limit: int = LIMIT, least: float = LEAST_SCORE, use_ratio: bool = True) -> DataFrame:
    """The pairs of a query and a label that are compared, with ``score`` and ``way`` (tokens, beginning, letters).

    Among them are the ``limit`` best of each query and source of those that reach ``least``, and perhaps others.
    """
    if least <= 0:
        raise ValueError("a least score of nothing asks for every label")
    q = queries.filter("text is not null").select("query_id", "text", normal_tokens(F.col("text")).alias("_qn"), raw_tokens(F.col("text")).alias("_qr")).dropDuplicates(["query_id", "text"])
    q = q.withColumns({"_qs": F.array_distinct("_qn"), "_q": F.array_join("_qn", " ")})
    c = listing.filter("label is not null").select("*", normal_tokens(F.col("label")).alias("_cn"), raw_tokens(F.col("label")).alias("_cr"))
    c = c.withColumns({"_cs": F.array_distinct("_cn"), "_c": F.array_join("_cn", " ")})
    # Which ways of finding labels any query needs; what no query needs is not done for any label.
    long, floor = F.length("_q") > SHORT, max(LEAST_RATIO, least)
    told = q.groupBy(_single().alias("single"), _turned().alias("turned"), long.alias("long")).agg(F.min(F.nullif(F.length("_q"), F.lit(0))).alias("shortest"), F.max(F.length("_q")).alias("longest")).collect()
    held = _held(q, c, limit, any(r["single"] for r in told)).withColumn("score", _own_score(None)).withColumn("way", F.lit("tokens"))
    out = [held]
    if (use_ratio or least <= PREFIX_BONUS) and any(r["turned"] for r in told):
        begun = _begun(q, c)
        own = ratio(F.col("_q"), F.col("_c"), F.lit(LEAST_RATIO)) if use_ratio else None
        out.append(begun.withColumn("score", _own_score(own)).withColumn("way", F.lit("beginning")))
    wanted: dict[int, tuple[int, int]] = {}
    for r in told if use_ratio else []:
        if r["longest"]:
            width = 2 if r["long"] else 1
            low, high = wanted.get(width, (r["shortest"], r["longest"]))
            wanted[width] = (min(low, r["shortest"]), max(high, r["longest"]))
    if wanted:
        w = W.partitionBy("query_id", "text", "source").orderBy(F.desc("score"))
        last = held.select("query_id", "text", "source", "score").withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == limit)
        last = last.select("query_id", "text", "source", F.greatest("score", F.lit(floor)).alias("_last"))
        letters = lambda n: F.when(_long_enough(F.length("_c"), *wanted[n], floor), _letters(F.col("_c"), n)).otherwise(F.array().cast("array<string>"))
        told = c.select(F.explode(F.concat(*[F.transform(letters(n), lambda g: F.struct(F.lit("g").alias("k"), g.alias("v"))) for n in wanted], F.array(F.struct(F.lit("s").alias("k"), F.col("source").cast("string").alias("v"))))).alias("x"))
        counted = told.groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("n")).collect()  # letters and sources are few
        grams, sources = {r["x"]["v"]: r["n"] for r in counted if r["x"]["k"] == "g"}, sum(r["x"]["k"] == "s" for r in counted)
        met = last.groupBy("query_id", "text").agg(F.min("_last").alias("_least"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == sources).drop("_n")
        same = lambda a, b, *on: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in on]
        asked = q.alias("q").join(met.alias("m"), same("q", "m", "query_id", "text"), "left").select("q.*", F.coalesce("m._least", F.lit(floor)).alias("_least"))
        pairs = _alike(asked, c, floor, wanted, grams)
        pairs = pairs.alias("p").join(last.alias("l"), same("p", "l", "query_id", "text", "source"), "left").select("p.*", F.greatest(F.coalesce("l._last", F.lit(floor)), "p._least").alias("_at"))
        pairs = pairs.filter(2 * F.least(F.length("_q"), F.length("_c")) >= F.col("_at") * (F.length("_q") + F.length("_c")) - 1e-9)
        alike = pairs.withColumn("_r", ratio(F.col("_q"), F.col("_c"), F.col("_at"))).filter(F.col("_r") >= F.col("_at") - 1e-9)
        out.append(alike.withColumn("score", _own_score(F.col("_r"))).withColumn("way", F.lit("letters")).drop("_r", "_at", "_least"))
    return reduce(DataFrame.unionByName, out).drop("_qn", "_qr", "_qs", "_q", "_cn", "_cr", "_cs", "_c")


def best_matches(queries: DataFrame, listing: DataFrame, limit: int = LIMIT, least: float = LEAST_SCORE, use_ratio: bool = True) -> DataFrame:
    """The ``limit`` best of each query and source, ties by ``ord``; then those of the least score.

    ``queries``: ``query_id, text``; ``listing``: ``source, ord, label`` and more.
    Defined cases: a null text or label matches nothing; names without letters or digits match one another; equal rows of
    queries are one query, of labels one each; no rows on either side give none.
    """
    w = W.partitionBy("query_id", "source").orderBy(F.desc("score"), "ord")
    found = candidates(queries, listing, limit, least, use_ratio).filter(F.col("score") >= least)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("way")
