"""Periodic runs of words by partition refinement.

Positions of a text are in one class of level ``L`` where the ``L`` words from there
are equal. Level by level the classes are split by those of the level before, at the
position to the left: of the parts of a class only the largest does not split others
in turn ("smaller half"), so a position does so a logarithmic number of times. A class
is a list linked in order of position; neighbours whose distance is the level itself
are a square, and squares of one period at positions in a row are a run. No square has
a period of its own that is shorter, as a nearer position would then lie between.

Only stretches that can hold a run are refined. A run of period ``q`` and at least
``max(LEAST, 3 q)`` words repeats ``LEAST - LEAST // 3`` words or more at distance ``q``, so
each of its words lies in a window of so many words that stands twice in the text.
Windows are looked up by hash, which can only keep more than needed; classes start
from the words themselves. What lies between stretches is a position equal to none.

Everything happens within a row: no exchange, and memory follows the longest text.

Defined cases: a null or empty text has no words, no run, and the digests of nothing; a
row without id is not remodelled; repeated rows are judged each; of runs of equal
exponent the first is told, then that of least period; no rows give none; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabularium.llm.common import spread
from tabularium.llm.textkernel import hash_windows, hash_words, row_batches, split_words, text_bytes, window_starts

LEAST, REPEATS = 24, 3
#: A run of ``q`` words' period repeats at least this many at distance ``q``: ``max(LEAST - q, (REPEATS - 1) q)`` is least at ``LEAST / REPEATS``.
SHARED = LEAST - LEAST // REPEATS


class Classes:
    """Classes of equal factors of a sequence, refined from one length to the next. ``symbols`` are from 0, without gaps."""

    def __init__(self, symbols: list[int], most: int):
        n = len(symbols)
        self.level, self.most = 1, most
        self.of, self.before, self.after = list(symbols), [-1] * n, [-1] * n
        self.size, self.first = [], []
        self.near: dict[int, list[int]] = {}
        members: list[list[int]] = [[] for _ in range(max(symbols, default=-1) + 1)]
        for i, s in enumerate(symbols):
            members[s].append(i)
        for c, m in enumerate(members):
            self.size.append(len(m))
            self.first.append(m[0])
            for i, j in zip(m, m[1:]):
                self._link(i, j)
        largest = max(range(len(members)), key=self.size.__getitem__, default=0)
        self.small = [m for c, m in enumerate(members) if c != largest]

    def _link(self, i: int, j: int) -> None:
        self.after[i], self.before[j] = j, i
        if self.level <= j - i <= self.most:
            self.near.setdefault(j - i, []).append(i)

    def squares(self) -> list[int]:
        """Positions at which a square begins whose period is the present level, in order."""
        d = self.level
        return sorted({i for i in self.near.pop(d, ()) if self.after[i] == i + d})

    def _leave(self, i: int) -> None:
        p, q, c = self.before[i], self.after[i], self.of[i]
        self.size[c] -= 1
        if p < 0:
            self.first[c] = q
        else:
            self.after[p] = -1
        if q >= 0:
            self.before[q] = -1
            if p >= 0:
                self._link(p, q)
        self.before[i] = self.after[i] = -1

    def refine(self) -> None:
        """Go on to factors one longer."""
        self.level += 1
        of, parts = self.of, {}
        for members in self.small:
            into: dict[int, int] = {}
            last: dict[int, int] = {}
            for i in members:
                if i == 0:
                    continue
                j = i - 1
                c = of[j]
                if c not in into:
                    if self.size[c] == 1:
                        continue  # alone already
                    into[c] = new = len(self.size)
                    self.size.append(0)
                    self.first.append(j)
                    parts.setdefault(c, []).append(new)
                new = into[c]
                self._leave(j)
                of[j] = new
                self.size[new] += 1
                if new in last:
                    self._link(last[new], j)
                last[new] = j
        self.small = []
        for c, new in parts.items():
            found = [k for k in (c, *new) if self.size[k]]
            largest = max(found, key=self.size.__getitem__)
            self.small += [self._members(k) for k in found if k != largest]

    def _members(self, c: int) -> list[int]:
        out, i = [], self.first[c]
        while i >= 0:
            out.append(i)
            i = self.after[i]
        return out


def runs(symbols: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``max(least, repeats * period)`` or more, by start and period."""
    most = len(symbols) // repeats
    if not most:
        return []
    # No factor reaches beyond the end: what stands there equals nothing.
    classes, out = Classes([*symbols, max(symbols) + 1], most), []
    while True:
        d, begun = classes.level, -1
        for i in [*classes.squares(), -2]:
            if begun >= 0 and i != end + 1:
                length = end - begun + 2 * d
                if length >= max(least, repeats * d):
                    out.append((begun, length, d))
                begun = -1
            if begun < 0:
                begun = i
            end = i
        if d >= most or not classes.near and not classes.small:
            return sorted(out, key=lambda r: (r[0], r[2]))
        classes.refine()


def source_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that each place of a remodelled text repeats; None where the text stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def stretches(hashes: np.ndarray, row: np.ndarray, width: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of words, each in a window of ``width`` that stands twice in its row."""
    at = window_starts(row, width)
    if not len(at):
        return at, at
    h = hash_windows(hashes, at, width) ^ (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    inside = np.cumsum(cover)[:-1] > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (row[1:] != row[:-1])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def text_runs(words: list[bytes], parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The runs of a text, all of which lie in the given stretches of its words."""
    known: dict[bytes, int] = {}
    symbols: list[int] = []
    places: list[int] = []
    for s, e in parts:
        symbols += [known.setdefault(w, len(known)) for w in words[s:e]]
        symbols.append(-1)
        places += range(s, e + 1)
    free = len(known)
    for i, x in enumerate(symbols):
        if x < 0:
            symbols[i], free = free, free + 1
    return [(places[s], n, q) for s, n, q in runs(symbols)]


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


SCHEMA = "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, remodel: bool = False, keep: bool = False) -> DataFrame:
    """A row a document: its number of runs, the one of greatest exponent, and digests of all runs and of what collapsing leaves.

    ``remodel`` makes the words of one id in ten periodic from some place on (:func:`source_places`). With ``keep`` the
    runs themselves and the collapsed text follow, in ``runs`` and ``collapsed``.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["runs", "collapsed"] * keep
    kinds = _KINDS + [_RUNS, pa.string()] * keep

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in row_batches(bounds):
                rows = [_judge(ids[i + k], *x, keep) for k, x in enumerate(_prepared(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], ids[i:j] if remodel else [None] * (j - i)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = SCHEMA + ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" * keep
    return spread(docs.select("doc_id", "text")).mapInArrow(judged, schema)


def _prepared(data: np.ndarray, bounds: np.ndarray, ids: list) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Words of each text, as remodelled, and the stretches that may hold runs."""
    s, e, row = split_words(data, bounds)
    hashes = hash_words(data, s, e)
    sizes = np.bincount(row, minlength=len(ids))
    ends = np.cumsum(sizes)
    moved = {}
    for k, (doc, n, end) in enumerate(zip(ids, sizes.tolist(), ends.tolist())):
        at = source_places(doc, n)
        if at is not None:
            moved[k] = at
            hashes[end - n : end] = hashes[end - n : end][at]
    starts, stops = stretches(hashes, row)
    owner = row[starts] if len(starts) else starts
    cut = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
    raw = data.tobytes()
    for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
        words = raw[bounds[k] : bounds[k + 1]].split()
        if k in moved:
            words = [words[i] for i in moved[k].tolist()]
        base = end - n
        yield words, [(int(a) - base, int(z) - base) for a, z in zip(starts[cut[k] : cut[k + 1]], stops[cut[k] : cut[k + 1]])]


def _judge(doc: int | None, words: list[bytes], parts: list[tuple[int, int]], keep: bool) -> tuple:
    found = text_runs(words, parts) if parts else []
    best = None
    for r in found:  # in order of start and period, so that ties keep the first
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    left = b" ".join(collapse(words, found))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    out = (doc, len(words), len(found), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
    return out + ([{"start": s, "length": n, "period": q} for s, n, q in found], left.decode()) if keep else out


#: The same in DuckDB's SQL: of pairs of equal words, stretches at one distance; where several distances share a stretch the least is its period.
ORACLE_SQL = f"""
with recursive r as (select i::bigint as i, i::bigint as v, 0 as k from range(256) t(i) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from r where k < 8),
tab as (select list(v order by i) as tab from r where k = 8),
d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
h as (select *, len(w) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) as h from d, tab),
g as (select doc_id, w, n, h % 10 = 0 and n > 0 as moved, case when n > 0 then (h // 10) % n end as a, case when n > 0 then 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) end as p from h),
e as (select doc_id, i, w[1 + case when moved and i >= a then a + (i - a) % p else i end] as x from (select *, unnest(range(n)) as i from g)),
q as (select l.doc_id, l.i, m.i - l.i as q from e l join e m on l.doc_id = m.doc_id and l.x = m.x and m.i > l.i),
s as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from q) group by doc_id, q, island having count(*) + q >= greatest({LEAST}, {REPEATS} * q)),
f as (select doc_id, start, length, min(q) as period from s group by all),
b as (select doc_id, count(*) as n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length::double / period, start, period)) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from f group by doc_id),
c as (select distinct f.doc_id, i from f join e on e.doc_id = f.doc_id and i >= start + period and i < start + length),
k as (select e.doc_id, string_agg(x, ' ' order by e.i) as left_over from e anti join c on e.doc_id = c.doc_id and e.i = c.i group by e.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period, cast(1000 * best.l // best.p as bigint) as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(left_over, '')) as collapsed_sha256
from d left join b using (doc_id) left join k using (doc_id)"""
