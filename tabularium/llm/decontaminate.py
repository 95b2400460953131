"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Tokens are runs of letters and digits, lower-cased in ASCII. Rolling Karp-Rabin
hashes of ``LEAST_MATCH`` tokens of the benchmark join with those of every text;
a text and an item that share one go to tiling: the longest match among tokens
not yet marked on either side is marked, again and again, until none of
``LEAST_MATCH`` tokens is left. An item is leaked where the tiles cover
``COVERAGE`` of its tokens, in whatever order they stand.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` (a longer
item alone); a larger one takes several passes over the texts, each with its block.

Defined cases: null texts and items are empty; items of fewer tokens than
``LEAST_MATCH`` are never leaked; repeated rows and items are judged each; a row
without id is reported with a null id; texts of any length are tiled whole; of
matches of one length that starting first in the text is marked; an empty table
on either side leaks nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import spread
from tabularium.llm.textkernel import draw_key, hash_windows, hash_words, row_batches, split_words, text_bytes, window_starts

LEAST_MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 16_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = False
_BREAK[128:] = False


def tokens(data: np.ndarray, bounds: np.ndarray, secret: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token."""
    data = _FOLD[data]
    s, e, row = split_words(data, bounds, _BREAK)
    return hash_words(data, s, e, secret), row


def _free(marked: np.ndarray) -> np.ndarray:
    """How many tokens from each place on are not marked."""
    stops = np.append(np.flatnonzero(marked), len(marked))
    return stops[np.searchsorted(stops, np.arange(len(marked)))] - np.arange(len(marked))


def tile(text: np.ndarray, item: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(place in text, place in item, length)``: the longest match of tokens not yet marked, again and again.

    Running Karp-Rabin: windows of one length on both sides are hashed in one pass, and the length is halved until some
    agree; between that and the last one tried the greatest is found by bisection. All matches of that length are marked,
    those starting first in the text first, each with the first free place in the item. Memory is linear in both.
    """
    done = [np.zeros(len(text), bool), np.zeros(len(item), bool)]
    # Tokens in no shared window of `least` are in no tile.
    for x, y, m in ((text, item, done[0]), (item, text, done[1])):
        ours, theirs = (hash_windows(z, np.arange(max(0, len(z) - least + 1)), least) for z in (x, y))
        cover = np.zeros(len(x) + 1, np.int64)
        seen = np.flatnonzero(np.isin(ours, theirs))
        np.add.at(cover, seen, 1)
        np.add.at(cover, seen + least, -1)
        m |= np.cumsum(cover)[:-1] == 0
    out: list[tuple[int, int, int]] = []
    top = min(len(text), len(item))
    while True:
        room = [_free(m) for m in done]
        top = min(top, *(int(r.max(initial=0)) for r in room))

        def shared(n: int) -> tuple[np.ndarray, ...]:
            """Places and hashes of the free windows of ``n`` tokens that both sides have."""
            at = [np.flatnonzero(r >= n) for r in room]
            h = [hash_windows(x, p, n) for x, p in zip((text, item), at)]
            both = [np.isin(h[0], h[1]), np.isin(h[1], h[0])]
            return at[0][both[0]], h[0][both[0]], at[1][both[1]], h[1][both[1]]

        n, above, found = top, top + 1, None
        while n >= least and found is None:
            got = shared(n)
            if len(got[0]):
                found = got
            elif n == least:
                return out
            else:
                n, above = max(least, n // 2), n
        if found is None:
            return out
        while above - n > 1:
            mid = (n + above) // 2
            got = shared(mid)
            if len(got[0]):
                n, found = mid, got
            else:
                above = mid
        places, hashes, targets, theirs = found
        order = np.argsort(theirs, kind="stable")
        targets, theirs = targets[order].tolist(), theirs[order]
        low, high = np.searchsorted(theirs, hashes, side="left").tolist(), np.searchsorted(theirs, hashes, side="right").tolist()
        next_at: dict[int, int] = {}
        end = 0
        for i, lo, hi in zip(places.tolist(), low, high):
            if i < end:
                continue
            k = next_at.get(lo, lo)
            while k < hi and (done[1][targets[k]] or done[1][targets[k] + n - 1]):
                k += 1  # windows of this length were all free, so one that is marked in part is marked at an end
            next_at[lo] = k
            if k < hi:
                j = targets[k]
                done[0][i : i + n] = done[1][j : j + n] = True
                out.append((i, j, n))
                end = i + n
        top = n - 1 if n > least else 0
        if not top:
            return out


@dataclass
class Index:
    """A block of benchmark items: their seeds, and the sorted loud ones. Items of equal tokens are one.

    Seeds are silent, the most common first, as long as all silent ones of an item cover less of it than a leak needs.
    So a leak has a loud seed, and a passage that many items share makes no candidates of those that it does not leak.
    """

    ids: list[list]
    items: list[np.ndarray]
    own: list[np.ndarray]
    loud: np.ndarray
    item: np.ndarray
    least: int
    coverage: float
    secret: bytes

    @classmethod
    def of(cls, ids: list, texts: list[str | None], least: int, coverage: float) -> Index:
        secret = draw_key()
        data, bounds = text_bytes(pa.array(texts, pa.large_string()))
        words, row = tokens(data, bounds, secret)
        ends = np.cumsum(np.bincount(row, minlength=len(ids)))
        same: dict[bytes, list] = {}
        for k, (e, n) in enumerate(zip(ends.tolist(), np.diff(ends, prepend=0).tolist())):
            if n >= least:
                same.setdefault(words[e - n : e].tobytes(), []).append(ids[k])
        items = [np.frombuffer(key, words.dtype) for key in same]
        sizes = np.array([len(x) for x in items], np.int64)
        words, row = np.concatenate([np.empty(0, words.dtype), *items]), np.repeat(np.arange(len(items)), sizes)
        at = window_starts(row, least)
        seeds, item = hash_windows(words, at, least), row[at]
        loud = cls._loud(seeds, item, at, row, np.maximum(np.ceil(coverage * sizes - 1e-9), 1).astype(np.int64), least)
        order = np.argsort(seeds[loud], kind="stable")
        own = np.split(seeds, np.cumsum(sizes - least + 1)[:-1]) if items else []
        return cls(list(same.values()), items, own, seeds[loud][order], item[loud][order], least, coverage, secret)

    @staticmethod
    def _loud(seeds: np.ndarray, item: np.ndarray, at: np.ndarray, row: np.ndarray, need: np.ndarray, least: int) -> np.ndarray:
        if not len(seeds):
            return np.empty(0, np.int64)
        code = np.unique(seeds, return_inverse=True)[1]
        uses = np.bincount(np.unique(code * len(need) + item) // len(need))[code]
        order = np.lexsort((at, -uses, item))
        rank = np.empty(len(seeds), np.int64)
        rank[order] = np.arange(len(seeds)) - np.searchsorted(item, item[order])
        # The rank with which each token is first covered; the item's share is reached with that of its `need`-th token.
        first = np.full(len(row), np.iinfo(np.int64).max)
        for k in range(least):
            np.minimum.at(first, at + k, rank)
        by_item = first[np.lexsort((first, row))]
        return np.flatnonzero(rank >= by_item[np.searchsorted(row, np.arange(len(need))) + need - 1][item])

    def candidates(self, h: np.ndarray, row: np.ndarray, most: int = 2_000_000) -> np.ndarray:
        """``row * items + item`` of all that share a loud seed, sorted; ``most`` bounds what is expanded at a time."""
        order = np.lexsort((h, row))  # a seed that a text repeats counts once
        h, row = h[order], row[order]
        new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
        lo = np.searchsorted(self.loud, h, side="left")
        near = np.flatnonzero(self.loud[np.minimum(lo, len(self.loud) - 1)] == h)
        n = np.searchsorted(self.loud, h[near], side="right") - lo[near]
        part = np.cumsum(n) // most
        found = [np.empty(0, np.int64)]
        for c, e in zip(*(lambda x: (x, [*x[1:], len(near)]))(np.flatnonzero(np.diff(part, prepend=-1)).tolist())):
            m = n[c:e]
            seed = np.repeat(lo[near[c:e]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            found.append(np.unique(np.repeat(row[near[c:e]], m) * len(self.items) + self.item[seed]))
        return np.unique(np.concatenate(found))

    def leaks(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(row, item, covered tokens, tiles, longest)`` of every leak in a batch of texts."""
        words, row = tokens(data, bounds, self.secret)
        at = window_starts(row, self.least)
        if not len(at) or not len(self.loud):
            return
        h, row_at = hash_windows(words, at, self.least), row[at]
        ends = np.cumsum(np.bincount(row, minlength=len(bounds) - 1))
        now = -1
        for pair in self.candidates(h, row_at).tolist():
            r, k = divmod(pair, len(self.items))
            if r != now:
                now, (c, e) = r, np.searchsorted(row_at, [r, r + 1])
                mine, text = np.unique(h[c:e]), words[ends[r] - (e - c) - self.least + 1 : ends[r]]
            size = len(self.items[k])
            near = np.isin(self.own[k], mine)
            reach = np.zeros(size, bool)
            for i in range(self.least):
                reach[i : i + len(near)] |= near
            if reach.sum() < self.coverage * size:
                continue  # what the seeds reach bounds what tiles can cover
            tiles = tile(text, self.items[k], self.least)
            covered = sum(t[2] for t in tiles)
            if covered >= self.coverage * size:
                yield r, k, covered, len(tiles), max(t[2] for t in tiles)


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list]:
    """The items in blocks of at most ``most`` bytes, but for an item of more than that, which is a block of its own.

    Items are dealt by a hash of their text; the number of blocks doubles until each fits. Equal items stay together.
    """
    rows = benchmark.select("item_id", "text").withColumn("_h", F.xxhash64("text"))
    n, size = 1, F.sum(F.octet_length("text"))
    while rows.groupBy(F.pmod("_h", F.lit(n)).alias("k")).agg(size.alias("b"), F.count_distinct("_h").alias("d")).filter((F.col("b") > most) & (F.col("d") > 1)).limit(1).count():
        n *= 2
    for k in range(n):
        items = (rows.filter(F.pmod("_h", F.lit(n)) == k) if n > 1 else rows).drop("_h").orderBy("item_id", "text").collect()
        if items or n == 1:
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_MATCH) -> DataFrame:
    """A row for each leaked item in each text: ``doc_id, item_id, n_tokens, n_covered, n_tiles, longest, coverage``."""
    texts = spread(docs.select("doc_id", "text"))
    schema = "doc_id bigint, item_id bigint, n_tokens bigint, n_covered bigint, n_tiles bigint, longest bigint"

    def scan(items: list) -> DataFrame:
        index = Index.of([r["item_id"] for r in items], [r["text"] for r in items], least, coverage)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, bounds = text_bytes(b.column(1))
                ids, rows = b.column(0), []
                for i, j in row_batches(bounds):
                    for r, k, covered, n, longest in index.leaks(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                        rows += [(ids[i + r].as_py(), item, len(index.items[k]), covered, n, longest) for item in index.ids[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], names=["doc_id", "item_id", "n_tokens", "n_covered", "n_tiles", "longest"])

        return texts.mapInArrow(found, schema)

    out = None
    for items in blocks(benchmark):
        out = scan(items) if out is None else out.unionByName(scan(items))
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_tokens"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_MATCH) -> DataFrame:
    """The rows of ``docs`` that leak no item; texts stay where they are."""
    docs = spread(docs)
    for items in blocks(benchmark):
        index = Index.of([r["item_id"] for r in items], [r["text"] for r in items], least, coverage)
        docs = docs.mapInArrow(_clean_rows(index), docs.schema)
    return docs


def _clean_rows(index: Index):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            keep = np.ones(b.num_rows, bool)
            for i, j in row_batches(bounds):
                for r, *_ in index.leaks(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
                    keep[i + r] = False
            yield b.filter(pa.array(keep))

    return clean
