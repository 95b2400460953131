"""Suffix-array dedup over sparse suffixes.

A passage of ``SPAN`` words that stands earlier too, at a smaller id or earlier in
the same text, is removed. Of every text only the suffixes at minimisers are kept:
of the first ``SPREAD`` positions of a passage that whose ``GRAM`` words hash lowest
(the leftmost on ties). It is chosen by content, so a passage brings its own
position along: both of its places have a suffix there, with at least ``DEPTH`` words
of the passage behind it and the rest before it. A suffix serves the passages that
begin ``low`` to ``high`` words before it, each passage one suffix.

Texts are dealt into blocks by a hash of their row. (1) Blocks list hashes of the
``DEPTH`` words at their suffixes; those that occur once anywhere are out. (2) The
others are sorted by their words, in each block first: the words that neighbours
have in common (the LCP array) tell the runs of suffixes that agree for ``r``
words, for each ``r`` from ``DEPTH`` to ``SPAN``. A match is then extended to the left
by the ``SPAN - r`` words that it still lacks; of the suffixes that agree in both
directions, all but the one of the first place are marked. (3) Suffixes with a
passage that is not met earlier in their block are sorted over the whole cluster
and compared likewise. Where a run goes on in another sorted partition, its passages
are grouped by hash instead, with partial sums, as such a run may be of any size.
(4) Blocks remove the passages at their marked suffixes.

Every passage of ``SPAN`` words lies at such a suffix, so exactly the words of
those that stand earlier are removed, as the SQL twin says. Contents that many
documents share have at most one row a block and context in any exchange.

Defined cases: null text has no words; rows without id come after all others and
count as one text by position; rows that repeat an id are the same text by
position; no rows give none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.llm.common import few_samples, materialise, text_size
from tabularium.llm.substrings import BLOCK_BYTES, NO_ID, _ordered, _table
from tabularium.llm.textkernel import U, draw_key, hash_windows, hash_words, mix, row_batches, split_words, text_bytes, window_starts

SPAN = 50
SPREAD = 24
GRAM = 4
REACH = SPREAD - 1
DEPTH = SPAN - REACH
#: Bytes of text for a partition of the cluster-wide sort.
SORTED_BYTES = 16_000_000


def minimisers(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of minimisers of passages, and how far before them the last and the first of their passages begins."""
    passages = window_starts(rows, SPAN)
    if not len(passages):
        return passages, passages, passages
    grams = window_starts(rows, GRAM)
    order = np.full(len(words) + SPREAD, np.iinfo(U).max, U)
    order[grams] = hash_windows(words, grams, GRAM)
    least, reach = np.arange(len(words)), 1
    while reach < SPREAD:
        by = min(reach, SPREAD - reach)
        ahead = np.minimum(np.arange(len(words)) + by, len(words) - 1)
        least = np.where(order[least] <= order[least[ahead]], least, least[ahead])
        reach += by
    at = least[passages]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at = at[cut]
    return at, at - passages[np.append(cut[1:], len(passages)) - 1], at - passages[cut]


class Suffixes:
    """The words of a block, on request spelled with a blank after each, and its sparse suffixes."""

    def __init__(self, block: pa.Table, secret: bytes, spelled: bool = False):
        data, bounds = text_bytes(block.column("text"))
        ids = block.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, at, low, high, key, row_of, words = ([np.empty(0, k)] for k in (np.int64, np.int64, np.int64, np.int64, U, np.int64, U))
        letters, ends, seen, written = [], [np.zeros(1, np.int64)], 0, 0
        for i, j in row_batches(bounds):
            part = data[bounds[i] : bounds[j]]
            s, e, row = split_words(part, bounds[i : j + 1] - bounds[i])
            h = hash_words(part, s, e, secret)
            p, near, far = minimisers(h, row)
            words.append(h)
            sizes.append(np.bincount(row, minlength=j - i))
            at.append(p + seen)
            low.append(near)
            high.append(far)
            key.append(hash_windows(h, p, DEPTH))
            row_of.append(row[p] + i)
            seen += len(h)
            if spelled:
                to = np.cumsum(e - s + 1)
                from_ = np.repeat(s - (to - (e - s + 1)), e - s + 1) + np.arange(to[-1] if len(to) else 0)
                plain = part[np.minimum(from_, max(len(part) - 1, 0))]
                plain[to - 1] = 32
                letters.append(plain.tobytes())
                ends.append(to + written)
                written += len(plain)
        self.sizes, self.at, self.low, self.high, self.key, self.row, self.words = (np.concatenate(x) for x in (sizes, at, low, high, key, row_of, words))
        self.letters, self.ends = b"".join(letters), np.concatenate(ends)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.doc, self.start = ids[self.row], (self.at - self.begins[self.row]).astype(np.int32)

    def spelled(self, which: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The words of each suffix's passages, before it and from it on."""
        at = self.at[which]
        a, b, c = (self.ends[x].tolist() for x in (at - self.high[which], at, at + SPAN - self.low[which]))
        return [self.letters[x:y] for x, y in zip(a, b)], [self.letters[x:y] for x, y in zip(b, c)]


def common_words(a: bytes, b: bytes) -> int:
    """Words that two spelled suffixes have in common from their start on."""
    if a == b:
        return a.count(b" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a.count(b" ", 0, lo)


def words_before(left: pa.Array, secret: bytes) -> np.ndarray:
    """For each suffix and number of words ``l`` a hash of the ``l`` words before it (column 0: of none); garbage where there are fewer."""
    data, bounds = text_bytes(left.cast(pa.large_binary()).cast(pa.large_string()))
    s, e, row = split_words(data, bounds)
    out = np.zeros((len(left), REACH + 1), U)
    back = np.cumsum(np.bincount(row, minlength=len(left)))[row] - np.arange(len(row))  # the nearest word: 1
    out[row, back] = hash_words(data, s, e, secret)
    for k in range(1, REACH + 1):
        out[:, k] = mix(out[:, k] ^ out[:, k - 1] * U(0x9E3779B97F4A7C15))
    return out


def earlier(lcp: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes: bit ``l`` where the passage that begins ``l`` words before a suffix stands earlier, and its first id (one column a bit).

    ``lcp[i]`` is how many words suffix ``i`` has in common with the one before it; it serves passages from ``low`` to ``high`` words before it.
    """
    n = len(lcp)
    order = np.lexsort((start, doc))
    new = np.ones(n, bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    id_of = doc[order][new]
    mask, first = np.zeros(n, np.int64), np.full((n, SPREAD), NO_ID)
    longest = np.maximum(lcp, np.append(lcp[1:], 0)) if n else lcp
    for k in range(SPREAD):
        r = SPAN - k
        at = np.flatnonzero((longest >= r) & (low <= k) & (k <= high))
        if not len(at):
            continue
        run = np.cumsum(lcp < r)[at]
        passage = mix(before[at, k] ^ mix(run.astype(U)))
        order = np.argsort(passage, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], passage[order][1:] != passage[order][:-1]]))
        least = np.empty(len(at), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(rank[at][order], cut), np.diff(np.append(cut, len(at))))
        late = rank[at] > least
        mask[at[late]] |= 1 << k
        first[at[late], k] = id_of[least[late]]
    return mask, first


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_NAMES = ["block", "doc", "start", "key", "mask", "firsts"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
_MARKS = "block bigint, doc bigint, start int, key bigint, mask int, firsts array<bigint>"
_BITS = np.arange(SPREAD)


def _firsts(mask: np.ndarray, first: np.ndarray) -> pa.Array:
    """The first id for each bit that is set, in order of bits."""
    bits = (mask[:, None] >> _BITS & 1).astype(bool)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(bits.sum(1))]), pa.int32()), pa.array(first[bits]))


def _same(doc: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for id, start and content of a suffix."""
    return mix(mix(doc.view(U) ^ mix(start.astype(U))) ^ key.view(U))


def find_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, first_docs, kept_sha256`` for every row; on request ``kept_text``.

    ``spans`` are the removed runs of words, ``start:end`` joined by commas; ``first_docs`` the ids at which their passages stand first.
    """
    (_, size), secret = text_size(docs), draw_key()
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SORTED_BYTES))
    text = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def listed(block: pa.Table) -> pa.Table:
        found, counts = np.unique(Suffixes(block, secret).key, return_counts=True)
        return pa.table([pa.array(found.view(np.int64)), pa.array(np.full(len(found), block.column("block")[0].as_py()), pa.int64()), pa.array(counts > 1)], names=["h", "block", "twice"])

    def chosen(block: pa.Table, often: pa.Table) -> pa.Table:
        names, kinds = [*_NAMES, "low", "high", "left", "right"], [*_KINDS, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        if not block.num_rows or not often.num_rows:
            return _table([], names, kinds)
        own = Suffixes(_ordered(block), secret, spelled=True)
        known = np.sort(often.column("h").to_numpy().view(U))
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, own.key), len(known) - 1)] == own.key)
        left, right = own.spelled(at)
        order = sorted(range(len(at)), key=right.__getitem__)
        at, left, right = at[np.array(order, np.int64)], [left[k] for k in order], [right[k] for k in order]
        lcp = np.array([0, *map(common_words, right, right[1:])][: len(right)], np.int64)
        low, high = own.low[at], own.high[at]
        mask, first = earlier(lcp, words_before(pa.array(left, pa.binary()), secret), low, high, own.doc[at], own.start[at])
        lone = mask != (1 << (high + 1)) - (1 << low)  # some passage is not met earlier in the block
        use = np.flatnonzero((mask != 0) | lone)
        at, sent = at[use], lone[use].tolist()
        cols = [np.full(len(use), block.column("block")[0].as_py()), own.doc[at], own.start[at], own.key[at].view(np.int64), mask[use], _firsts(mask[use], first[use])]
        cols += [low[use], high[use], *([words[k] if s else None for k, s in zip(use.tolist(), sent)] for words in (left, right))]
        return pa.table([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(cols, kinds)], names=names)

    def compared(batches):
        """Marks of a sorted partition; the suffixes of its first and last run give a row for each of their passages, to be grouped with other partitions'."""
        names, kinds = [*_NAMES, "bit", "h1", "h2"], [*_KINDS, pa.int32(), pa.int64(), pa.int64()]
        kept, lcp, last, runs = [], [], b"", 0
        begin = now = []  # the words of the first run, and of the one at hand
        for b in batches:
            if not b.num_rows:
                continue
            for x in b.column("right").to_pylist():
                lcp.append(common_words(last, x))
                if lcp[-1] < DEPTH:
                    now, runs = [], runs + 1
                    begin = now if runs == 1 else begin
                now.append(x)
                last = x
            kept.append(b.drop_columns(["right"]))
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        lcp = np.array(lcp, np.int64)
        col = {c: table.column(c).combine_chunks().to_numpy() for c in (*_NAMES[:4], "low", "high")}
        before = words_before(table.column("left").combine_chunks(), secret)
        mask, first = earlier(lcp, before, col["low"], col["high"], col["doc"], col["start"])
        run = np.cumsum(lcp < DEPTH)
        at = np.flatnonzero((mask != 0) & (run != run[0]) & (run != run[-1]))
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(col[c][at]) for c in _NAMES[:4]), pa.array(mask[at], pa.int32()), _firsts(mask[at], first[at]), pa.nulls(len(at), pa.int32()), none, none], names=names)
        edge, words = np.flatnonzero((run == run[0]) | (run == run[-1])), [*begin, *now] if run[0] != run[-1] else now
        for c in range(0, len(edge), 5_000):
            some = edge[c : c + 5_000]
            many = col["high"][some] - col["low"][some] + 1
            i, k = np.repeat(some, many), np.concatenate([np.arange(a, b + 1) for a, b in zip(col["low"][some].tolist(), col["high"][some].tolist())])
            h = np.array([_passage(x, SPAN - n) for x, a, b in zip(words[c : c + 5_000], col["low"][some].tolist(), col["high"][some].tolist()) for n in range(a, b + 1)], np.int64).reshape(-1, 2)
            h1 = mix(np.ascontiguousarray(h[:, 0]).view(U) ^ before[i, k]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(col[x][i]) for x in _NAMES[:4]), pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.list_(pa.int64())), pa.array(k, pa.int32()), pa.array(h1), pa.array(h[:, 1])], names=names)

    out_names = ["doc_id", "n_words", "n_removed", "spans", "first_docs", "kept_sha256"] + ["kept_text"] * keep_text
    out_kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()] + [pa.string()] * keep_text

    def kept(block: pa.Table, marks: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table([], out_names, out_kinds)
        block = _ordered(block)
        data, bounds = text_bytes(block.column("text"))
        sizes = np.concatenate([np.empty(0, np.int64), *(np.bincount(split_words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[2], minlength=j - i) for i, j in row_batches(bounds))])
        begins = np.cumsum(sizes) - sizes
        step, firsts = np.zeros(int(sizes.sum()) + 1, np.int64), {}
        if marks.num_rows:
            own = Suffixes(block, secret)
            col = {c: marks.column(c).combine_chunks() for c in _NAMES[1:]}
            theirs = _same(*(col[c].to_numpy() for c in _NAMES[1:4]))
            order = np.argsort(theirs)
            theirs, mask = theirs[order], col["mask"].to_numpy().astype(np.int64)[order]
            first, offset = col["firsts"].flatten().to_numpy(), col["firsts"].offsets.to_numpy()[:-1][order] - col["firsts"].offsets[0].as_py()
            mine = _same(own.doc, own.start, own.key)
            lo, hi = np.searchsorted(theirs, mine, side="left"), np.searchsorted(theirs, mine, side="right")
            i = np.repeat(np.arange(len(mine)), hi - lo)  # a suffix, and
            m = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(i))  # a mark of it
            place, row, told = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            nth = offset[m]
            for x in range(SPREAD):
                has = np.flatnonzero(mask[m] >> x & 1)
                place.append(own.at[i[has]] - x)
                row.append(own.row[i[has]])
                told.append(first[nth[has]])
                nth[has] += 1
            place, row, told = (np.concatenate(x) for x in (place, row, told))
            step += np.bincount(place, minlength=len(step)) - np.bincount(place + SPAN, minlength=len(step))
            # Of a passage that stands earlier in the block, another suffix knows where it is first of all.
            passage = np.unique(hash_windows(own.words, place, SPAN), return_inverse=True)[1]
            least = np.full(passage.max(initial=0) + 1, NO_ID)
            np.minimum.at(least, passage, told)
            for r, f in np.unique(np.stack([row, least[passage]]), axis=1).T.tolist():
                firsts.setdefault(r, []).append(f)
        gone = np.cumsum(step)[:-1] > 0
        rows = []
        for k, (i, t) in enumerate(zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist())):
            words, mask = (t or "").encode().split(), gone[begins[k] : begins[k] + sizes[k]]
            removed = int(mask.sum())
            body = b" ".join(compress(words, (~mask).tolist()) if removed else words)
            spans = ",".join(f"{s}:{e}" for s, e in _runs(mask)) if removed else ""
            ids = [None if d == NO_ID else d for d in firsts.get(k, ())]
            rows.append((i, len(words), removed, spans, ids, hashlib.sha256(body).hexdigest()) + ((body.decode(),) if keep_text else ()))
        return _table(rows, out_names, out_kinds)

    everywhere = W.partitionBy("h")
    found = text.groupBy("block").applyInArrow(listed, "h bigint, block bigint, twice boolean")
    often = found.withColumn("n", F.count(F.lit(1)).over(everywhere)).filter("n > 1 or twice").select("h", "block")
    own = materialise(text.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(chosen, _MARKS + ", low int, high int, left binary, right binary"), "suffixes")
    sent = own.filter("right is not null").select(*_NAMES[:4], "low", "high", "left", "right")
    ordered = sent.repartitionByRange(parts, "right", "doc", "start").sortWithinPartitions("right", "doc", "start")
    with few_samples(docs.sparkSession):
        marks = materialise(ordered.mapInArrow(compared, _MARKS + ", bit int, h1 bigint, h2 bigint"), "marks")
    passages = marks.filter("bit is not null")
    places = passages.groupBy("bit", "h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = passages.join(places, ["bit", "h1", "h2"]).filter(F.struct("doc", "start") > F.col("first"))
    late = late.select(*_NAMES[:4], F.expr("shiftleft(1, bit)").alias("mask"), F.array("first.doc").alias("firsts"))
    told = own.filter("mask != 0").select(*_NAMES).unionByName(marks.filter("bit is null").select(*_NAMES)).unionByName(late)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans string, first_docs array<bigint>, kept_sha256 string" + ", kept_text string" * keep_text
    return text.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(kept, schema)


def _passage(right: bytes, words: int) -> tuple[int, int]:
    """Two hashes of the first words of a spelled suffix."""
    digest = hashlib.blake2b(b" ".join(right.split(b" ", words)[:words]), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


#: The same in DuckDB's SQL; passages as digests of joined words.
ORACLE_SQL = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
     p as (select doc_id, unnest(range(1, len(w) - {SPAN - 2})) as s, w from w where len(w) >= {SPAN}),
     k as (select doc_id, s, md5(array_to_string(w[s : s + {SPAN - 1}], ' ')) as k from p),
     f as (select k, min((doc_id, s)) as f from k group by k),
     g as (select doc_id, s, f[1] as first from k join f using (k) where (doc_id, s) > f),
     h as (select doc_id, array_to_string(list_sort(list_distinct(list(first))), ',') as firsts from g group by doc_id),
     c as (select distinct doc_id, unnest(range(s, s + {SPAN})) as i from g),
     d as (select doc_id, count(*) as gone from c group by doc_id),
     x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w),
     y as (select x.doc_id, string_agg(word, ' ' order by x.i) as body from x left join c on x.doc_id = c.doc_id and x.i = c.i where c.i is null group by x.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(firsts, '') as first_docs, sha256(coalesce(body, '')) as kept_sha256
from w left join d using (doc_id) left join h using (doc_id) left join y using (doc_id)"""
