"""Importance resampling of documents towards a target distribution.

Features are hashed runs of one to three words. A bucket's gain is the logarithm of
how much likelier it is in the target than in the corpus, in whole thousandths; a
document's weight is the sum of the gains of its features, read from an array. With
Gumbel noise from the id added, the highest scores are a draw without replacement.

(1) One pass counts the buckets of all documents, one of the target; both end as arrays of
``BUCKETS`` numbers. (2) A second pass scores every document and writes a narrow table.
(3) Each partition of it makes sorted runs of at most ``RUN`` eligible rows and writes
them in segments, cut where ranges of scores end. Ends of ranges are taken from a
sample of bounded size and follow the draw, so that a range has about ``RANGE`` rows;
ids and row numbers break ties, so rows of one score are not bound to one range.
(4) Ranges are counted, and those behind the draw are left where they are. Of the
others each merges its segments by a tournament tree, the last one only up to the
exact draw count. A rank is a place in the range and the count of the ranges before it.

Defined cases: a null or empty text has no features and weight 0; a row without id has
the noise of an empty id and comes after all ids of its score; repeated rows are drawn
each; fewer eligible rows than make one draw none; no target text is a target of no
features; no rows give none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import bounded_sample, materialise, spread

BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
SLICE = 1_000_000  # bytes of a text whose features are held at a time
RUN = 250_000
RANGE, MOST_RANGES, PER_RANGE = 50_000, 2_000, 20
NO_ID = np.iinfo(np.int64).max

#: Letters A to Z in lower case; what is no digit, letter or byte of a further character parts words.
_FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in slices of about ``SLICE`` bytes."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice of a text its number of words, and the bucket of every feature that ends in it."""
    before: list[bytes] = []
    for words in word_slices(text):
        if not words:
            continue
        own = [*before, *words]
        skip = len(before)  # features that end in the words before have been told
        one = list(map(zlib.crc32, own))
        two = list(map(zlib.crc32, own[1:], map(zlib.crc32, repeat(b" "), one)))
        three = list(map(zlib.crc32, own[2:], map(zlib.crc32, repeat(b" "), two)))
        crc = np.array(one[skip:] + two[max(0, skip - 1) :] + three[max(0, skip - 2) :], np.int64)
        yield len(words), crc % BUCKETS
        before = own[-2:]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for _, f in features(t):
                    total += np.bincount(f, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in spread(texts.select("text")).mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the corpus."""
    of_corpus, of_target = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * of_corpus / ((s + 1) * of_target))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes, weights = [], [], []
            for t in b.column(1).to_pylist():
                n = m = w = 0
                for k, f in features(t):
                    n, m, w = n + k, m + len(f), w + int(gain[f].sum())
                words.append(n)
                sizes.append(m)
                weights.append(w)
            score = [w + noise(i, seed) for w, i in zip(weights, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (words, sizes, weights, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return spread(docs.select("doc_id", "text")).mapInArrow(weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


Key = tuple[int, int, int]  # falling score, id, row: least first
_KEY = [("score", "<i8"), ("doc", "<i8"), ("row", "<i8")]


def _keys(b: pa.RecordBatch) -> np.ndarray:
    ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    out = np.empty(b.num_rows, _KEY)
    out["score"], out["doc"], out["row"] = -b.column("score").to_numpy(), ids, b.column("_row").to_numpy()
    return out


def sorted_runs(rows: DataFrame, ends: np.ndarray) -> DataFrame:
    """Segments ``range, n, data`` of sorted runs. Range ``k`` holds what is greater than ``ends[k - 1]`` and at most ``ends[k]``."""

    def segments(keys: np.ndarray) -> pa.RecordBatch:
        keys.sort(order=("score", "doc", "row"))
        cut = [0, *np.searchsorted(keys, ends, side="right").tolist(), len(keys)]
        found = [(k, e - s, keys[s:e].tobytes()) for k, (s, e) in enumerate(zip(cut, cut[1:])) if e > s]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary()))], names=["range", "n", "data"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(_keys(b))
            n += b.num_rows
            if n >= RUN:
                yield segments(np.concatenate(held))
                held, n = [], 0
        if n:
            yield segments(np.concatenate(held))

    return rows.select("score", "doc_id", "_row").mapInArrow(sort, "range int, n bigint, data binary")


def merged(runs: list[list[Key]]) -> Iterator[Key]:
    """Sorted runs as one, by a tournament tree: each inner node keeps the loser of its match, and the winner's run is played anew."""
    k = 1
    while k < len(runs):
        k *= 2
    over = (math.inf,)
    heads = [iter(r) for r in runs]
    front = [next(h, over) for h in heads] + [over] * (k - len(runs))
    winner, loser = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if front[a] <= front[b] else (b, a)
    best = winner[1] if k > 1 else 0
    while front[best] is not over:
        yield front[best]
        front[best] = next(heads[best], over)
        node = (best + k) // 2
        while node:
            if front[loser[node]] < front[best]:
                best, loser[node] = loser[node], best
            node //= 2


def drawn(eligible: DataFrame, total: int, draw: int) -> DataFrame:
    """``_row, rank`` of the ``draw`` first of ``total`` rows ``score, doc_id, _row``."""
    sizes: dict[int, int] = {}
    for share in (min(1.0, 1.2 * draw / total), 1.0):
        ranges = min(MOST_RANGES, max(1, math.ceil(total * share / RANGE)))
        rows = bounded_sample(eligible.select("score", "doc_id", "_row"), math.ceil(PER_RANGE * ranges / share), "_row").collect()
        keys = sorted((-r["score"], NO_ID if r["doc_id"] is None else r["doc_id"], r["_row"]) for r in rows)
        kept = math.ceil(len(keys) * share)
        ends = np.array([keys[kept * k // ranges - 1] for k in range(1, ranges + 1) if kept * k // ranges], _KEY)
        runs = materialise(sorted_runs(eligible, np.unique(ends)), "runs")
        sizes = {r["range"]: r["n"] for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect()}
        if share == 1 or sum(n for k, n in sizes.items() if k < ranges) >= draw:
            break  # the draw ends in one of the narrow ranges
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    last = max(k for k in before if before[k] < draw)

    def merge(segments: pa.Table) -> pa.Table:
        base, own = before[segments.column("range")[0].as_py()], []
        runs = [np.frombuffer(d.as_py(), _KEY).tolist() for d in segments.column("data")]
        for key in merged(runs):
            if base + len(own) == draw:
                break
            own.append(key[2])
        return pa.table({"_row": pa.array(own, pa.int64()), "rank": pa.array(range(base + 1, base + 1 + len(own)), pa.int64())})

    return runs.filter(F.col("range") <= last).groupBy("range").applyInArrow(merge, "_row bigint, rank bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; rank is null where a row is not drawn.

    Of the rows of at least ``least`` words, ``percent`` in a hundred are drawn, those of the highest scores.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = materialise(scored(docs, gain, seed).withColumn("_row", F.monotonically_increasing_id()), "scored")
    eligible = rows.filter(F.col("n_words") >= least)
    total = eligible.count()
    draw = percent * total // 100
    if not draw:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return rows.join(drawn(eligible, total, draw), "_row", "left").select("doc_id", "n_features", "weight", "score", "rank")


#: The same in DuckDB's SQL. A CRC-32 is made byte by byte from a table of 256 remainders, which eight halvings of each number give.
ORACLE_SQL = f"""
with recursive r as (select i::bigint as i, i::bigint as v, 0 as k from range(256) t(i) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from r where k < 8),
tab as (select list(v order by i) as tab from r where k = 8),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
b as (select list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
df as (select doc_id, array_to_string(w[s : s + n - 1], ' ') as f from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (values (1), (2), (3)) v(n))),
bf as (select array_to_string(w[s : s + n - 1], ' ') as f from (select w, n, unnest(range(1, len(w) - n + 2)) as s from b, (values (1), (2), (3)) v(n))),
u as (select distinct f from df union select distinct f from bf),
h as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1 : 2 * i])::bigint)),
        lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) % {BUCKETS} as bucket from u, tab),
s as (select bucket, count(*) as s from df join h using (f) group by bucket), t as (select bucket, count(*) as t from bf join h using (f) group by bucket),
a as (select (select count(*) from df)::double as s_all, (select count(*) from bf)::double as t_all),
g as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (t_all + {BUCKETS})))) as bigint) as gain from (s full join t using (bucket)), a),
w as (select doc_id, count(*) as n_features, sum(gain) as weight from df join h using (f) join g using (bucket) group by doc_id),
x as (select d.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight, ('0x' || sha256('{SEED}:' || d.doc_id)[1:8])::bigint as h from d left join w using (doc_id)),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from x),
z as (select doc_id, row_number() over (order by score desc, doc_id) as rank from y where n_words >= {LEAST_WORDS} qualify rank <= {PERCENT} * (select count(*) from y where n_words >= {LEAST_WORDS}) // 100)
select doc_id, cast(n_features as bigint) as n_features, weight, score, cast(rank as bigint) as rank from y left join z using (doc_id)"""
