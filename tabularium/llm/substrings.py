"""Substring dedup behind a count-min prefilter.

A window is ``WIDTH`` consecutive words of one text. Words that a window covers
whose word sequence also starts earlier (at a smaller id, or earlier in the same
text) are removed; all windows are judged on the input.

Texts are dealt into blocks by a hash of their row, once; every pass reads that
exchange. (1) Each block sends a sketch: the cells of its windows in ``DEPTH``
rows of counters, as delta-coded cell numbers with a mark for two or more.
(2) Sketches are merged by shards of the cell space, and each block gets back one
bit a cell: whether the merged count reaches two. Beyond ``2 ** FAN_BITS`` shards this
goes level by level: sketches of ``2 ** FAN_BITS`` blocks are merged by a prefix of
the cells before they are sent to finer shards, and answers come back the same way,
so that the rows of an exchange grow with the blocks and not with their square. The sketch's width follows the
number of windows, and no part of it is ever broadcast. (3) The blocks send the
windows all of whose cells reach two, one a sequence and block, to be grouped
exactly, by 96 bits of two hashes of the words under a key drawn for the run. A window that occurs
twice is always among them. (4) Blocks learn which of their windows start earlier
elsewhere, and find repeats within the block themselves.

A sequence has at most one row a block in any group, so text that a third of all
documents share makes no large group.

Defined cases: null text has no words; rows without id come after all others and
count as one text by position; rows that repeat an id are the same text by
position, so equal rows keep what starts nowhere earlier; no rows give none.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import text_size
from tabularium.llm.textkernel import U, draw_key, hash_windows, hash_words, mix, row_batches, split_words, text_bytes, window_starts

WIDTH = 20
DEPTH = 2
LOAD = 4  # cells of a sketch row for each window
BLOCK_BYTES = 8_000_000
SHARD_CELLS = 2_000_000
FAN_BITS = 8
NO_ID = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length as byte planes, compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).ravel())
        at += n * s
    return out


def _ordered(block: pa.Table) -> pa.Table:
    """Rows of a block in an order that does not depend on how they arrived."""
    return block.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _keys(block: pa.Table, secret: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: two hashes (64 and 32 bits), id and starting word; and the words of each row."""
    data, bounds = text_bytes(block.column("text"))
    ids = block.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    k1, k2, doc, start, sizes = [np.empty(0, U)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for i, j in row_batches(bounds):
        part = data[bounds[i] : bounds[j]]
        s, e, row = split_words(part, bounds[i : j + 1] - bounds[i])
        n = np.bincount(row, minlength=j - i)
        words, at = hash_words(part, s, e, secret), window_starts(row, WIDTH)
        k1.append(hash_windows(words, at, WIDTH, 0))
        k2.append((hash_windows(words, at, WIDTH, 1) >> U(32)).astype(np.uint32))
        doc.append(ids[i:j][row[at]])
        start.append((at - (np.cumsum(n) - n)[row[at]]).astype(np.int32))
        sizes.append(n)
    return tuple(np.concatenate(x) for x in (k1, k2, doc, start, sizes))


def _cells(k1: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of all sketch rows, their counts, and each window's places among them (one column a row)."""
    cells = np.concatenate([(mix(k1 ^ U(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) >> U(64 - bits)) | U(r << bits) for r in range(DEPTH)])
    found, inverse, counts = np.unique(cells, return_inverse=True, return_counts=True)
    return found, counts, inverse.reshape(DEPTH, -1)


def _split(found: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """``(shard, from, to)`` of sorted cells."""
    shard = (found >> U(shift)).astype(np.int64)
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    return [(int(shard[s]), int(s), int(e)) for s, e in zip(at, [*at[1:], len(found)])]


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


_BLOCK_ROW = (["shard", "block", "data"], [pa.int64(), pa.int64(), pa.binary()])


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row; on request ``kept_text``."""
    (_, size), secret = text_size(docs), draw_key()
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    windows = max(1, size // 5)
    bits = min(48, max(12, math.ceil(math.log2(windows * LOAD))))
    shards = max(1, math.ceil(windows * DEPTH / SHARD_CELLS))
    whole = bits + (DEPTH - 1).bit_length()
    fine = min(whole - 1, math.ceil(math.log2(shards)))  # bits of a cell that name its shard
    levels = [whole - min(k * FAN_BITS, fine) for k in range(1, max(1, math.ceil(fine / FAN_BITS)) + 1)]  # what each level shifts off
    groups = max(1, math.ceil(windows / (4 * SHARD_CELLS)))

    text = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def sketched(block: pa.Table) -> pa.Table:
        found, counts, _ = _cells(_keys(block, secret)[0], bits)
        return sent(found, counts > 1, block.column("block")[0].as_py(), levels[0])

    def sent(found: np.ndarray, often: np.ndarray, sender: int, shift: int) -> pa.Table:
        """Sorted cells and which count two or more, a row a shard."""
        rows = []
        for shard, i, j in _split(found, shift):
            delta = np.diff(found[i:j], prepend=U(shard << shift)).astype(np.uint64)
            delta = delta.astype(np.uint32) if int(delta.max()) < 1 << 32 else delta
            rows.append((shard, sender, bytes([delta.itemsize]) + _pack(delta) + np.packbits(often[i:j]).tobytes() + np.uint32(j - i).tobytes()))
        return _table(rows, *_BLOCK_ROW)

    def entries(data: bytes, shard: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(np.frombuffer(data[-4:], np.uint32)[0])
        marks = (n + 7) // 8
        (delta,) = _unpack(data[1 : -4 - marks], f"u{data[0]}")
        return np.cumsum(delta.astype(U)) + U(shard << shift), np.unpackbits(np.frombuffer(data[-4 - marks : -4], np.uint8), count=n).astype(bool)

    def together(rows: pa.Table, shift: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The cells of several senders, which of them count two or more together, and where each sender's are among them."""
        s = rows.column("shard")[0].as_py()
        parts = [entries(d.as_py(), s, shift) for d in rows.column("data")]
        found, inverse, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        often = counts > 1
        often[inverse[np.concatenate([p[1] for p in parts])]] = True
        return found, often, np.split(inverse, np.cumsum([len(p[0]) for p in parts])[:-1])

    def replied(rows: pa.Table, often: np.ndarray, places: list[np.ndarray]) -> pa.Table:
        s = rows.column("shard")[0].as_py()
        return _table([(s, b, np.packbits(often[p]).tobytes()) for b, p in zip(rows.column("block").to_pylist(), places)], *_BLOCK_ROW)

    def heard(found: np.ndarray, answers: pa.Table, shift: int) -> np.ndarray:
        """The answers to sorted cells, put together."""
        told, often = dict(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist())), np.zeros(len(found), bool)
        for shard, i, j in _split(found, shift):
            often[i:j] = np.unpackbits(np.frombuffer(told[shard], np.uint8), count=j - i)
        return often

    def answered(rows: DataFrame, level: int) -> DataFrame:
        """For each row of cells one bit a cell: whether all senders together count two or more."""
        shift = levels[level]
        if level == len(levels) - 1:

            def merged(shard: pa.Table) -> pa.Table:
                _, often, places = together(shard, shift)
                return replied(shard, often, places)

            return rows.groupBy("shard").applyInArrow(merged, row)
        below = levels[level + 1]

        def bundled(some: pa.Table) -> pa.Table:
            found, often, _ = together(some, shift)
            return sent(found, often, some.column("block")[0].as_py() >> FAN_BITS, below)

        def unbundled(some: pa.Table, answers: pa.Table) -> pa.Table:
            if not some.num_rows:
                return _table([], *_BLOCK_ROW)
            found, _, places = together(some, shift)
            return replied(some, heard(found, answers, below), places)

        rows = rows.withColumn("bundle", F.shiftright("block", FAN_BITS))
        told = answered(rows.groupBy("shard", "bundle").applyInArrow(bundled, row), level + 1)
        told = told.withColumn("above", F.shiftright("shard", shift - below))
        return rows.groupBy("shard", "bundle").cogroup(told.groupBy("above", "block")).applyInArrow(unbundled, row)

    def chosen(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return _table([], *_BLOCK_ROW)
        b = block.column("block")[0].as_py()
        k1, k2, doc, start, _ = _keys(_ordered(block), secret)
        found, _, places = _cells(k1, bits)
        at = np.flatnonzero(heard(found, answers, levels[0])[places].all(0))
        at = at[np.lexsort((start[at], doc[at], k2[at], k1[at]))]
        first = np.ones(len(at), bool)
        first[1:] = (k1[at][1:] != k1[at][:-1]) | (k2[at][1:] != k2[at][:-1])
        at = np.sort(at[first])  # windows are in order of id and start, which compresses
        to = (k1[at] % U(groups)).astype(np.int64)
        rows = []
        for g in np.unique(to).tolist():
            w = at[to == g]
            rows.append((g, b, _pack(k1[w], k2[w], np.diff(doc[w], prepend=0), start[w])))
        return _table(rows, *_BLOCK_ROW)

    def later(group: pa.Table) -> pa.Table:
        parts = [_unpack(d.as_py(), "u8", "u4", "i8", "i4") for d in group.column("data")]
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        k1, k2, start = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
        doc = np.concatenate([np.cumsum(p[2]) for p in parts])
        order = np.lexsort((start, doc, k2, k1))
        k1, k2, doc, start, owner = k1[order], k2[order], doc[order], start[order], owner[order]
        first = np.ones(len(k1), bool)
        first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        after = (doc > doc[head]) | (start > start[head])
        g, names, rows = group.column("shard")[0].as_py(), group.column("block").to_pylist(), []
        for o in np.unique(owner[after]).tolist():
            w = np.flatnonzero(after & (owner == o))
            w = w[np.lexsort((start[w], doc[w]))]
            rows.append((g, names[o], _pack(np.diff(doc[w], prepend=0), start[w])))
        return _table(rows, *_BLOCK_ROW)

    out_names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    out_kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text

    def kept(block: pa.Table, marks: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table([], out_names, out_kinds)
        block = _ordered(block)
        k1, k2, doc, start, sizes = _keys(block, secret)
        gone = np.zeros(len(k1), bool)
        # Repeats within the block: only windows whose first hash repeats are compared.
        order = np.sort(k1)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, k1), len(twice) - 1)
            at = np.flatnonzero(twice[place] == k1)
            at = at[np.lexsort((start[at], doc[at], k2[at], k1[at]))]
            first = np.ones(len(at), bool)
            first[1:] = (k1[at][1:] != k1[at][:-1]) | (k2[at][1:] != k2[at][:-1])
            head = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
            gone[at[(doc[at] > doc[head]) | (start[at] > start[head])]] = True
        if marks.num_rows:
            parts = [_unpack(d.as_py(), "i8", "i4") for d in marks.column("data")]
            far = np.rec.fromarrays([np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])], names="d,s")
            far.sort(order=("d", "s"))
            # Windows stand in order of id and start, except where an id repeats: look each one up.
            lo = np.searchsorted(far.d, doc, side="left")
            hi = np.searchsorted(far.d, doc, side="right")
            some = np.flatnonzero(hi > lo)
            if len(some):
                dense = np.cumsum(np.diff(far.d, prepend=far.d[0]) != 0)
                mine = dense[lo[some]].astype(np.int64) << 32 | start[some]
                gone[some[np.isin(mine, dense.astype(np.int64) << 32 | far.s)]] = True
        ends = np.cumsum(sizes)
        # Global places of the windows' words: windows of a row follow one another from its first word.
        n_windows = np.maximum(sizes - WIDTH + 1, 0)
        row = np.repeat(np.arange(len(sizes)), n_windows)
        place = (ends - sizes)[row] + start
        cover = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
        np.add.at(cover, place[gone], 1)
        np.add.at(cover, place[gone] + WIDTH, -1)
        stay = np.cumsum(cover)[:-1] == 0
        rows = []
        for k, (i, t) in enumerate(zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist())):
            words, mask = (t or "").encode().split(), stay[ends[k] - sizes[k] : ends[k]]
            removed = len(words) - int(mask.sum())
            body = b" ".join(compress(words, mask.tolist()) if removed else words)
            rows.append((i, len(words), removed, hashlib.sha256(body).hexdigest()) + ((body.decode(),) if keep_text else ()))
        return _table(rows, out_names, out_kinds)

    row = "shard bigint, block bigint, data binary"
    sketch = text.groupBy("block").applyInArrow(sketched, row)
    answers = answered(sketch, 0)
    found = text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(chosen, row)
    marks = found.groupBy("shard").applyInArrow(later, row)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return text.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(kept, schema)


#: The same in DuckDB's SQL; word sequences as joined strings.
ORACLE_SQL = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
     p as (select doc_id, unnest(range(1, len(w) - {WIDTH - 2})) as s, w from w where len(w) >= {WIDTH}),
     k as (select doc_id, s, md5(array_to_string(w[s : s + {WIDTH - 1}], ' ')) as k from p),
     f as (select k, min((doc_id, s)) as f from k group by k),
     g as (select doc_id, s from k join f using (k) where (doc_id, s) > f),
     c as (select distinct doc_id, unnest(range(s, s + {WIDTH})) as i from g),
     d as (select doc_id, list(i) as gone from c group by doc_id),
     x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from w),
     y as (select x.doc_id, string_agg(word, ' ' order by x.i) as body from x left join c on x.doc_id = c.doc_id and x.i = c.i where c.i is null group by x.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from w left join d using (doc_id) left join y using (doc_id)"""
