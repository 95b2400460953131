"""Best-fit packing of token pieces by a configuration linear program over the length histogram.

The program: the least sum of amounts of configurations (multisets of lengths that
fit ``capacity`` tokens) that covers the histogram. Multiplicative weights solve it
with a knapsack dynamic program over the capacity that prices the configurations
(:func:`prices`, :func:`fractional`); the prices prove a bound. Amounts are then
rounded, and what is left goes to the fullest place that holds it, longest first.
The histogram has ``capacity`` cells at most, so the driver's part is bounded,
however many pieces there are.

Pieces get their places by rank within their length. Ranks are counted in
salted groups, so that a length which a third of all pieces share is no one
task's work.

Defined cases: null text is empty and packs as the end token alone; repeated
rows are packed each; rows without id keep the null; no rows give no sequences.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.llm.common import materialise, spread
from tabularium.llm.textkernel import text_bytes

CAPACITY = 2048
END = 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Steepness of prices, share of a count that a step covers, steps for the dual prices and for the solution.
ETA, PART, STEPS, ROUNDS = 5.0, 0.03, 150, 160
#: How much less than 1 a configuration that is taken may be worth: at prices found by weights, and where lengths themselves are prices.
NEAR, TIGHT = 0.03, 0.0005
WORSE = 0.001
GROUP = 50_000

Config = tuple[tuple[int, int], ...]

#: First bytes of characters beyond Latin letters. Texts with one, and texts that may hold a special token, go whole to
#: the tokenizer file's own library; for the others its vocabulary as ranks gives the same ids in a third of the time.
_BEYOND = np.zeros(256, bool)
_BEYOND[0xC9:] = True


class Encoder:
    """Packed little-endian token ids of texts, the same as the tokenizer file gives."""

    def __init__(self, file: str, ranks_file: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._tok, self._fast = Tokenizer.from_file(file), None
        if ranks_file is not None:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text of a column (nulls: none)."""
        data, bounds = text_bytes(column)
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BEYOND[data], out=sums[1:])
        beyond = (sums[bounds[1:]] > sums[bounds[:-1]]).tolist()
        for text, odd in zip(column.to_pylist(), beyond):
            if not text:
                yield b""
            elif odd or self._fast is None or "<|" in text:
                yield self.whole(text)
            else:
                yield self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(file: str | None) -> Encoder:
    key = file or ""
    if key not in _encoders:
        if file is None:
            import public_tokenizers

            _encoders[key] = Encoder(str(public_tokenizers.path(VOCABULARY)), str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
        else:
            _encoders[key] = Encoder(file)
    return _encoders[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; only the first may be short."""
    first = n - (math.ceil(n / capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """A row a piece: ``doc_id, piece, start, length, ids_crc32``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, end = encoder(tokenizer_file), np.array([END], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), known.encode(b.column(1))):
                ids += end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
            cols = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(docs.select("doc_id", "text")).mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity the greatest price of a multiset of lengths in it, and the last length taken there (0: none).

    ``price[l]`` is the price of length ``l``; ``price[0]`` is unused.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = price[::-1]  # back[-1 - l] is the price of l
    n = len(price)
    for c in range(1, capacity + 1):
        lo = max(0, c - n + 1)
        gain = best[lo:c] + back[n - 1 - c + lo : n - 1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], c - (lo + k)
        else:
            best[c] = best[c - 1]
    return best, last


def taken(last: np.ndarray, room: int) -> Iterator[int]:
    """The lengths that the dynamic program puts into a room."""
    while room > 0:
        x = int(last[room])
        if x:
            yield x
        room -= max(x, 1)


def holding(x: int, last: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of a length and what the dynamic program puts beside it."""
    out = {x: 1}
    for y in taken(last, capacity - x):
        out[y] = out.get(y, 0) + 1
    return out


def prices(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float, float]:
    """Prices of lengths at which no configuration is worth more than 1, the bound on sequences that they prove, and how near to 1 to stay.

    Where every length stands in some configuration that is nearly full, its share of the capacity is such a price. Else
    multiplicative weights find better ones: in each step every length's best configuration covers a part of its count, and
    a length's price falls exponentially with how often it is covered beyond the least covered one.
    """
    some = np.flatnonzero(counts)
    need, size = counts.astype(float), np.arange(capacity + 1) / capacity
    found, bound, cover = None, 0.0, np.zeros(capacity + 1)
    for step in range(STEPS):
        share = np.divide(cover, need, out=np.zeros(capacity + 1), where=need > 0)
        price = np.where(need > 0, size * np.exp(-ETA * (share - share[some].min())), 0)
        best, last = knapsack(price[: some[-1] + 1], capacity)
        if best[capacity] and (price * need).sum() / best[capacity] > bound:
            found, bound = price / best[capacity], float((price * need).sum() / best[capacity])
        worth = price[some] + best[capacity - some]
        if step == STEPS // 5 and bound < 1.001 * (size * need).sum():
            break  # volume is all there is to the bound
        if not best[capacity] or step == 0 and (worth >= 1 - TIGHT).all():
            return size, bound, TIGHT
        room = PART * need
        for x in some[np.argsort(share[some] - 1e-6 * worth, kind="stable")].tolist():
            if room[x] > 0:
                config = holding(x, last, capacity)
                amount = min(room[y] / a for y, a in config.items())
                for y, a in config.items():
                    room[y] -= a * amount
                    cover[y] += a * amount
    volume = float((size * need).sum())
    return (size, max(bound, volume), TIGHT) if found is None or bound < 1.001 * volume else (found, bound, NEAR)


def fractional(counts: np.ndarray, capacity: int) -> tuple[dict[Config, float], float]:
    """A fractional solution, ``configuration -> amount``, that covers no length more than its count; and the dual bound.

    Multiplicative weights over time: after each of ``ROUNDS`` steps every length is to be covered by as large a part. A price
    is that of :func:`prices`, times an exponential of how far the length is behind; one dynamic program prices all
    configurations, and for every length the best one that holds it is taken if at the dual prices it is worth nearly 1,
    by the amount that the length and its neighbours are behind. What no such configuration covers is left over.
    """
    some = np.flatnonzero(counts)
    if not len(some):
        return {}, 0.0
    base, bound, near = prices(counts, capacity)
    need, cover, out = counts.astype(float), np.zeros(capacity + 1), {}
    idle = 0
    for step in range(2 * ROUNDS):
        level = min(1.0, (step + 1) / ROUNDS)
        room = need * level - cover
        behind = room > 1e-6 * need
        share = np.divide(cover, need, out=np.zeros(capacity + 1), where=need > 0)
        price = np.where(behind, base * np.exp(-ETA * (share - level)), 0)
        best, last = knapsack(price[: some[-1] + 1], capacity)
        asked, before = np.flatnonzero(behind), len(out)
        took = 0.0
        for x in asked[np.argsort(-(price[asked] + best[capacity - asked]), kind="stable")].tolist():
            if room[x] <= 1e-6 * need[x]:
                continue
            config = holding(x, last, capacity)
            if sum(a * base[y] for y, a in config.items()) < 1 - near:
                continue
            amount = min(room[y] / a for y, a in config.items())
            if amount > 1e-9:
                key = tuple(sorted(config.items(), reverse=True))
                out[key] = out.get(key, 0.0) + amount
                took += amount
                for y, a in config.items():
                    room[y] -= a * amount
                    cover[y] += a * amount
        idle = 0 if took else idle + 1
        if level == 1 and idle > 3:
            break
    return out, bound


def rounded(found: dict[Config, float], counts: np.ndarray) -> tuple[dict[Config, int], np.ndarray]:
    """Whole amounts, and the pieces left: floors, then one more of those with the greatest fractions while their pieces last."""
    left, out = counts.copy(), {}

    def take(config: Config, n: int) -> None:
        out[config] = out.get(config, 0) + n
        for x, a in config:
            left[x] -= a * n

    for config, amount in found.items():
        if n := int(amount + 1e-6):
            take(config, n)
    for config, _ in sorted(found.items(), key=lambda c: -((c[1] + 1e-6) % 1)):
        if all(left[x] >= a for x, a in config):
            take(config, 1)
    return out, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram longest first, each length into the open sequences that it fills most; equal ones move together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces = np.zeros(capacity + 1, np.int64)

    def put(content: tuple[int, ...], n: int, r: int) -> None:
        room.setdefault(r, []).append((content, n))
        spaces[r] += n

    for x in range(len(left) - 1, 0, -1):
        k = int(left[x])
        while k:
            fit = np.flatnonzero(spaces[x:])
            if len(fit):
                r = x + int(fit[0])
                content, n = room[r].pop()
                spaces[r] -= n
                m = min(n, k)
                if n > m:
                    put(content, n - m, r)
                put((*content, x), m, r - x)
            else:
                m = min(k, max(1, k // max(1, capacity // x)))
                put((x,), m, capacity - x)
            k -= m
    return [(c, n) for group in room.values() for c, n in group]


@dataclass(frozen=True)
class Plan:
    """``configs``: lengths in order and how many sequences take them; every piece is in one.

    ``value`` is that of the fractional solution with what it leaves packed by best fit, ``bound`` the dual bound, which no
    packing goes below; ``placed`` of ``pieces`` are in sequences that rounding kept of the program, best fit has the rest.
    """

    configs: list[tuple[tuple[int, ...], int]]
    value: float
    bound: float
    placed: int
    pieces: int


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Solve, round, and pack what rounding leaves. Pieces that fill a sequence alone need no program.

    Where best fit of all pieces needs fewer sequences by more than one in a thousand (``WORSE``), its packing stands, and ``placed`` is 0.
    """
    left = counts.copy()
    left[0] = 0
    whole = int(left[capacity])
    left[capacity] = 0
    pieces = int(left.sum())
    found, bound = fractional(left, capacity)
    cover = np.zeros(capacity + 1)
    for config, amount in found.items():
        for x, a in config:
            cover[x] += a * amount
    open_ = np.maximum(0, np.ceil(left - cover - 1e-6)).astype(np.int64)
    value = sum(found.values()) + sum(n for _, n in best_fit(open_, capacity))
    kept, rest = rounded(found, left)
    configs = [(tuple(x for x, a in c for _ in range(a)), n) for c, n in kept.items()] + best_fit(rest, capacity)
    alone = best_fit(left, capacity)
    if sum(n for _, n in alone) < (1 - WORSE) * sum(n for _, n in configs):
        configs, rest = alone, left
    return Plan(([((capacity,), whole)] if whole else []) + configs, value + whole, bound + whole, pieces - int(rest.sum()), pieces)


def slots(configs: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length, and the sequence and offset at which each range starts."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for config, n in configs:
        at = 0
        for x in config:
            rows.append((x, rank[x], base, at))
            rank[x] += n
            at += x
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "rank": cols[1], "base": cols[2], "offset": cols[3]}


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length."""
    salts = max(1, math.ceil(rows / GROUP))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    return salted.withColumn("_own", own).join(sizes, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_salt", "_own", "_before")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    pieces = materialise(tokenise(docs, capacity, tokenizer_file), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    table = slots(plan(counts, capacity).configs, capacity)
    key = table["length"] * (1 << 44) + table["rank"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            cols = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table["base"][k] + rank - table["rank"][k]), pa.array(table["offset"][k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, int(counts.sum())).mapInArrow(placed, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
