"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Base counts of every whole text, then a vector of transformed statistics: log
mean word length, square roots of the symbol and repeated-word shares, log of
repeated lines. For the corpus, each language, and each
language and source the minimum-covariance-determinant estimate is sought by
concentration steps: the ``KEEP_SHARE`` of the group with least Mahalanobis
distance gives the next mean and covariance. Steps start from three estimates
(medians with fixed scales, all documents, directions from the medians), and of
the three ends that of least determinant stays. As in the regularised estimator
(MRCD), a small constant diagonal is added, since a statistic may be constant in
a group. A document beyond ``CUTOFF`` is rejected.

A group is never too small to be judged: its estimate is mixed with that of its
language as if ``SHRINK`` documents were like the language, the language's with the
corpus' alike, so that what a group's size changes, it changes gradually. The
corpus' covariance is mixed with the constant diagonal.

One aggregate a step gives counts and moments by bin of the distance, for all
groups and starts; the nearest bins that hold the share are summed. So no group
is ever in one task, and nothing depends on the order of merging but roundings.

Defined cases: null text is empty (no words: fails the base rules); null
language or source is a value of its own; repeated rows are judged each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.llm.common import discard, materialise, spread

WINDOW = 8
LEAST_WORDS = 20
SHRINK = 40
KEEP_SHARE = 0.75
STEPS = 4
BIN = 1 / 256
DIMS = ("x1", "x2", "x3", "x4")
#: Standard deviations below which a statistic's spread is not taken to be: what a reader would not notice.
FLOORS = (0.10, 0.08, 0.15, 0.50)
#: Squared distance: the 0.999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 18.47
_BROADCAST_GROUPS = 50_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_window_words(w: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of ``width`` words (a power of two) found twice or more in the text."""

    def covered(s: Column) -> Column:
        twice = F.filter(
            F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["p"])),
            lambda p: p.isNotNull(),
        )
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.array_sort(twice), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")), lambda a: a["n"])

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    def doubled(k: int):  # hashes of 2 k words from those of k
        return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda x, y: F.xxhash64(x, y))

    hashes, reach = F.transform(w, lambda x: F.xxhash64(x)), 1
    while reach < width:
        hashes, reach = let(hashes, doubled(reach)), reach * 2
    return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts and base verdict beside the columns of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.select("*", words(text).alias("_w"), lines.alias("_l"))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeated_window_words(F.col("_w")),
        }
    ).drop("_w", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def transformed() -> list[Column]:
    """The statistic vector; the mean word length is shrunk, since short texts vary more."""
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    return [
        F.log((c + 300.0) / (n + 60.0)).alias("x1"),
        F.sqrt(F.col("n_symbols") / (c + 100.0)).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / (n + 20.0)).alias("x3"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("x4"),
    ]


def chi2_cdf(x: float, even: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, even // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def consistency(share: float, dims: int) -> float:
    """What makes the covariance of the inner ``share`` of normal data unbiased."""
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < share else (lo, mid)
    return share / chi2_cdf(hi, dims + 2)


def _with_params(rows: DataFrame, params: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """Join by ``grp``: broadcast while groups are few, else with salted rows, as one group may hold a third of them."""
    if groups <= _BROADCAST_GROUPS:
        return rows.join(F.broadcast(params), "grp", how)
    salts = 64
    right = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(right, ["grp", "_salt"], how).drop("_salt")


def group_medians(rows: DataFrame, groups: int) -> DataFrame:
    """``grp`` and ``m_i``: upper edges of the histogram bins in which each group's medians lie."""
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) / BIN).alias("bin")) for i, x in enumerate(DIMS)])).alias("e"))
    bins = long.groupBy("grp", "e.dim", "e.bin").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("grp", "dim")
    bins = bins.withColumns({"cum": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).filter("2 * cum >= all")
    return bins.groupBy("grp").agg(*[((F.min(F.when(F.col("dim") == i, F.col("bin"))) + 1) * BIN).alias(f"m_{i}") for i in range(len(DIMS))])


_PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
_PARAMS = [f"m_{i}" for i in range(len(DIMS))] + [f"c_{i}_{j}" for i, j in _PAIRS]


def cholesky(params: DataFrame) -> DataFrame:
    """Adds the lower factor ``l_i_j`` of ``c_i_j`` with floors on the diagonal, and ``det``, the logarithm of its determinant."""
    det = F.lit(0.0)
    for i, j in _PAIRS:
        at = F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            at = at - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(at, F.lit(1e-9))) if i == j else at / F.col(f"l_{j}_{j}"))
        det = det + F.log(f"l_{i}_{j}") if i == j else det
    return params.withColumn("det", 2 * det)


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance under the row's ``m_i`` and ``l_i_j``."""
    d2 = F.lit(0.0)
    for i, x in enumerate(DIMS):
        at = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            at = at - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        rows = rows.withColumn(f"y_{i}", at / F.col(f"l_{i}_{i}"))
        d2 = d2 + F.col(f"y_{i}") * F.col(f"y_{i}")
    return rows.withColumn("d2", d2).drop(*[f"y_{i}" for i in range(len(DIMS))])


def _sums() -> list[Column]:
    """Count, and sums of the statistics and of their products."""
    return [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s_{i}") for i, x in enumerate(DIMS)] + [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q_{i}_{j}") for i, j in _PAIRS]


def _moments(sums: DataFrame, scale: float) -> DataFrame:
    """Mean and covariance from sums."""
    out = sums.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(len(DIMS))})
    cov = lambda i, j: (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale
    return out.withColumns({f"c_{i}_{j}": F.greatest(cov(i, j), F.lit(0.0)) if i == j else cov(i, j) for i, j in _PAIRS})


def starts(fit: DataFrame, groups: int) -> DataFrame:
    """Three estimates a group, ``start`` 0 to 2: medians with fixed scales, all rows, and directions from the medians."""
    med = materialise(group_medians(fit, groups), "mcd")
    fixed = med.withColumns({f"c_{i}_{j}": F.lit(0.04 if i == j else 0.0) for i, j in _PAIRS})
    z = [(F.col(x) - F.col(f"m_{i}")) / FLOORS[i] for i, x in enumerate(DIMS)]
    way = _with_params(fit, med, groups).withColumn("_z", F.sqrt(F.greatest(sum((v * v for v in z), F.lit(0.0)), F.lit(1e-12))))
    signs = [F.avg(z[i] * z[j] / (F.col("_z") * F.col("_z"))).alias(f"a_{i}_{j}") for i, j in _PAIRS]
    sums = way.groupBy("grp").agg(*_sums(), *signs, *[F.first(f"m_{i}").alias(f"med_{i}") for i in range(len(DIMS))])
    sums = materialise(sums, "mcd")
    whole = _moments(sums, 1.0)
    turned = sums.withColumns({f"m_{i}": F.col(f"med_{i}") for i in range(len(DIMS))} | {f"c_{i}_{j}": F.col(f"a_{i}_{j}") * (len(DIMS) * FLOORS[i] * FLOORS[j]) for i, j in _PAIRS})
    out = [df.select("grp", F.lit(k).alias("start"), *_PARAMS) for k, df in enumerate((fixed, whole, turned))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def concentrated(fit: DataFrame, params: DataFrame, groups: int, share: float = KEEP_SHARE) -> DataFrame:
    """Mean and covariance of the nearest ``share`` of each group under each start's estimate; ``n_all`` rows in all."""
    near = with_distance(_with_params(fit, cholesky(params), groups))
    bins = near.groupBy("grp", "start", F.floor(F.log1p("d2") / BIN).alias("bin")).agg(*_sums())
    w = W.partitionBy("grp", "start")
    bins = bins.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n_all": F.sum("n").over(w)})
    inner = bins.filter(F.col("before") < share * F.col("n_all"))
    names = ["n", *[f"s_{i}" for i in range(len(DIMS))], *[f"q_{i}_{j}" for i, j in _PAIRS]]
    return _moments(inner.groupBy("grp", "start").agg(F.max("n_all").alias("n_all"), *[F.sum(c).alias(c) for c in names]), consistency(share, len(DIMS)))


def estimate(fit: DataFrame, groups: int, steps: int = STEPS, share: float = KEEP_SHARE) -> DataFrame:
    """``grp, n_all``, centre and covariance: of the ends of the concentration steps, that of least determinant."""
    params = materialise(starts(fit, groups), "mcd")
    for _ in range(steps):
        old, params = params, materialise(concentrated(fit, params, groups, share).select("grp", "start", "n_all", *_PARAMS), "mcd")
        discard(old)
    best = cholesky(params).groupBy("grp").agg(F.min(F.struct("det", "start", "n_all", *_PARAMS)).alias("x"))
    return best.select("grp", "x.det", "x.start", "x.n_all", *[f"x.{c}" for c in _PARAMS])


def blended(own: DataFrame, wider: DataFrame | None, shrink: float = SHRINK) -> DataFrame:
    """``own`` (with ``up``, the wider group's name) mixed with ``shrink`` rows of the wider group: mean, and the mixture's covariance."""
    p = len(DIMS)
    n, k = F.col("n_all").cast("double"), float(shrink)
    if wider is None:
        prior = {f"c_{i}_{j}": (F.col(f"c_{i}_{j}") * n + (k * FLOORS[i] ** 2 if i == j else 0.0)) / (n + k) for i, j in _PAIRS}
        return own.withColumns(prior)
    other = wider.select(F.col("grp").alias("up"), *[F.col(c).alias("w" + c) for c in _PARAMS])
    both = own.join(other, "up")
    gap = lambda i: F.col(f"m_{i}") - F.col(f"wm_{i}")
    new = {f"m_{i}": (F.col(f"m_{i}") * n + F.col(f"wm_{i}") * k) / (n + k) for i in range(p)}
    new |= {f"c_{i}_{j}": (F.col(f"c_{i}_{j}") * n + F.col(f"wc_{i}_{j}") * k) / (n + k) + gap(i) * gap(j) * n * k / ((n + k) * (n + k)) for i, j in _PAIRS}
    return both.withColumns(new).drop(*["w" + c for c in _PARAMS])


def judge(docs: DataFrame, cutoff: float = CUTOFF, shrink: float = SHRINK) -> DataFrame:
    """A slim row a document: id, text hash, counts, base verdict, squared distance (null: not judged), verdict."""
    slim = base_counts(spread(docs.select("doc_id", "text", "lang", "source"))).withColumn("text_hash", F.xxhash64("text")).drop("text")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?"))
    by_lang, by_pair = F.concat_ws("\x1f", F.lit("lang"), name("lang")), F.concat_ws("\x1f", F.lit("own"), name("lang"), name("source"))
    slim = materialise(slim.select("*", *transformed(), by_pair.alias("grp"), by_lang.alias("up")), "rules")
    fit = slim.filter(~F.col("base_failed"))
    names = materialise(fit.groupBy("grp", "up").agg(F.count(F.lit(1)).alias("n")), "groups")
    groups = names.count()
    # Every document counts for its source, its language and the corpus.
    fit = fit.select(F.explode(F.array("grp", "up", F.lit("all"))).alias("grp"), *DIMS)
    found = materialise(estimate(fit, groups), "mcd")
    top = blended(found.filter("grp = 'all'"), None, shrink)
    langs = blended(found.join(names.select(F.col("up").alias("grp")).distinct(), "grp").withColumn("up", F.lit("all")), top, shrink)
    own = blended(found.join(names.select("grp", "up"), "grp"), langs, shrink)
    factor = [f"m_{i}" for i in range(len(DIMS))] + [f"l_{i}_{j}" for i, j in _PAIRS]
    params = materialise(cholesky(own).select("grp", *factor), "mcd")
    out = with_distance(_with_params(slim, params, groups, "left")).drop(*factor, "grp", "up")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))


def apply_rules(docs: DataFrame, **knobs) -> DataFrame:
    """The kept rows of ``docs``, with their columns as they are."""
    keep = judge(docs, **knobs).filter("kept").select(F.col("doc_id").alias("_k"), F.col("text_hash").alias("_h"))
    at = docs["doc_id"].eqNullSafe(keep["_k"]) & (F.xxhash64(docs["text"]) == keep["_h"])
    return docs.join(keep, at, "left_semi")
