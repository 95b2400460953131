"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then a score of the restored text.

A character trigram model is counted over the whole corpus. Any token with a
look-alike character or a doubled letter, and any chain of three or more single
characters with separators between, becomes a lattice: each character may stand
for the letters it resembles or itself, a separator or a repetition for nothing.
The Viterbi path that the model and the channel find likeliest replaces the span.
Words without any of these are left alone.

The score: log-odds weights of words and word beginnings, learned from a bounded
sample of labelled rows outside the held-out fold, summed over the strongest
evidence of a text, and mapped to [0, 1] by a logistic curve.

Defined cases: null and empty texts have no evidence and get the curve's value
at none; rows without id are never learned from; no labels at all, or none of one
kind, give every text the score 0; of labels that repeat an id the toxic one
holds; repeated rows are scored each; long texts and spans are decoded whole;
of equally likely forms the one whose last letters come later is taken; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import bounded_sample, discard, materialise, spread
from tabularium.llm.textkernel import row_batches, text_bytes

#: Documented bounds of the fit: labelled rows, and features that the model keeps.
SAMPLE_ROWS, MOST_FEATURES = 20_000, 4_096
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 5)
LEAST_SUPPORT, LEAST_WEIGHT, LEAST_Z = 5, 2.0, 2.5
#: Weights of the strongest, second and third evidence: one sure word tells nearly all.
TOP = (1.0, 0.25, 0.1)

#: Symbols of the model: 0 boundary, 1-26 letters, 27 digits, 28 letters beyond ASCII.
SYMBOLS = 29
_SYMBOL = np.zeros(256, np.int32)
for _c in range(26):
    _SYMBOL[97 + _c] = _SYMBOL[65 + _c] = _c + 1
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28

#: What a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SEPARATORS = " .-_*~/\\\n\r\t"
_SYMBOLS = "@$!|+(€£"
_PART = rf"[^\W_]|[{re.escape(_SYMBOLS)}]"
_SPACED = re.compile(rf"(?<![^\W_])(?<![{re.escape(_SYMBOLS)}])(?:(?:{_PART})[{re.escape(_SEPARATORS)}]+){{2,}}(?:{_PART})(?!{_PART})")
#: Marks that end a word, or open one, without standing for a letter.
_CLOSING, _OPENING = "!|+", "(|+"
_WORD = re.compile(r"[^\W\d_]+")

def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the ``SYMBOLS`` cubed trigrams over all texts; a table bounded by the alphabet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            data, bounds = text_bytes(b.column(0))
            for i, j in row_batches(bounds):
                s = _SYMBOL[data[bounds[i] : bounds[j]]]
                s = np.concatenate([[0, 0], s, [0, 0]])
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select("text").mapInArrow(counted, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after two others, smoothed by the bigrams and unigrams."""
    uni = (counts.sum((0, 1)) + 1.0) / (counts.sum() + SYMBOLS)
    bi = (counts.sum(0) + 20 * uni) / (counts.sum((0, 2)) + 20)[:, None]
    return np.log((counts + 20 * bi[None]) / (counts.sum(2) + 20)[:, :, None])


Options = list[tuple[str, float]]


def lattice(span: str) -> list[Options]:
    """What each character of a span may stand for, nothing included, and the channel's cost of it.

    A separator may be dropped, and so may a letter equal to the last one. A letter written twice costs more to drop than
    one of a longer run, the less so where several are. Figures among figures and marks around a word stay at no cost.
    """
    low = span.lower()
    begin, end = len(low) - len(low.lstrip(_OPENING)), len(low.rstrip(_CLOSING))
    number = low[begin:end].isdigit()
    twice = sum(a == b and a.isalpha() for a, b in zip(low, low[1:]))
    drop = -4.0 if twice < 2 else -1.5
    spaced = any(c in _SEPARATORS for c in low)
    out = []
    for i, c in enumerate(low):
        if c in _SEPARATORS and spaced:
            options: Options = [("", 0.0), (" ", -3.0)]
        elif c in LOOKALIKES:
            options = [(x, -1.0) for x in LOOKALIKES[c]] + [(c, 0.0 if number or not begin <= i < end else -3.0 if c.isdigit() else -8.0)]
        else:
            options = [(c, 0.0)]
        if i > 0 and low[i - 1] == c and c.isalpha():
            longer = low[i - 2 : i - 1] == c or low[i + 1 : i + 2] == c
            options.append(("", -0.5 if longer else drop))
        out.append(options)
    return out


@cache
def symbol(x: str) -> int:
    return ord(x) - 96 if "a" <= x <= "z" else 27 if x.isdigit() else 28 if x.isalpha() else 0


def viterbi(span: str, model: list[list[list[float]]]) -> str:
    """The likeliest restored form of a span, by the channel's costs and the character model.

    States are the last two symbols written; a path is a chain of what it wrote, so time and memory are linear in the span.
    """
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(span):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        coded = [(x, symbol(x), cost) if x else (x, -1, cost) for x, cost in options]
        for (a, b), (score, wrote) in paths.items():
            after = model[a][b]
            for x, k, cost in coded:
                if k < 0:
                    to, s = (a, b), score + cost
                else:
                    to, s = (b, k), score + cost + after[k]
                old = nxt.get(to)
                if old is None or s > old[0]:
                    nxt[to] = (s, (x, wrote) if x else wrote)
        paths = nxt
    wrote = max(paths.items(), key=lambda p: (p[1][0] + model[p[0][0]][p[0][1]][0], p[0]))[1][1]
    out = []
    while wrote is not None:
        x, wrote = wrote
        out.append(x)
    return "".join(reversed(out))


_THRICE = re.compile(r"(.)\1\1", re.S)


def undoubled(word: str, model: list[list[list[float]]]) -> str:
    """What :func:`viterbi` gives for letters of which none stands three times in a row.

    There each doubled letter is kept or dropped for itself: both states before it end in the same letter, and whichever
    is left, the letter after the pair sees one of two contexts.
    """
    pairs = [i for i in range(1, len(word)) if word[i] == word[i - 1]]
    drop = -4.0 if len(pairs) < 2 else -1.5
    code = [0, *map(symbol, word), 0]  # code[i + 1] is that of word[i]
    gone = []
    for i in pairs:
        x, before = code[i + 1], code[i - 1]
        if drop + model[before][x][code[i + 2]] > model[before][x][x] + model[x][x][code[i + 2]]:
            gone.append(i)
    for i in reversed(gone):
        word = word[:i] + word[i + 1 :]
    return word


@cache
def _classes() -> np.ndarray:
    """Of every code point of the first plane: bit 0 a part of a token, 1 a letter, 2 a letter or digit, 3 a look-alike."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        out[c] = x.isalnum() * 5 + x.isalpha() * 2
    for x in _SYMBOLS:
        out[ord(x)] |= 1
    for x in LOOKALIKES:
        out[ord(x)] |= 8
    return out


def _class_of(points: np.ndarray) -> np.ndarray:
    table = _classes()
    out = table[np.minimum(points, 0xFFFF)]
    for k in np.flatnonzero(points > 0xFFFF).tolist():
        x = chr(points[k])
        out[k] = x.isalnum() * 5 + x.isalpha() * 2
    return out


class Restorer:
    """Restores texts; keeps the decoded form of the spans seen last."""

    def __init__(self, model: np.ndarray, kept: int = 200_000):
        self._model, self._kept, self._memo = model.tolist(), kept, {}

    def _decode(self, span: str) -> str:
        out = self._memo.get(span)
        if out is None:
            if len(self._memo) >= self._kept:
                self._memo.clear()
            out = self._memo[span] = undoubled(span, self._model) if span.isalpha() and not _THRICE.search(span) else viterbi(span, self._model)
        return out

    def __call__(self, text: str) -> str:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None], most: int = 1_000_000) -> list[str]:
        """Restored texts, lower-cased; nulls are empty. Tokens are found on arrays of code points, some texts at a time."""
        out: list[str] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append((text or "").lower())
            size += len(some[-1])
            if size >= most:
                out += self._restored(some)
                some, size = [], 0
        return out + (self._restored(some) if some else [])

    def _restored(self, texts: list[str]) -> list[str]:
        chained, whole, bounds, start, end, kind = self._tokens(texts)
        if chained:  # spaced letters are joined first; what comes of them may be a token to restore
            for k in chained:
                texts[k] = _SPACED.sub(lambda m: self._decode(m[0]), texts[k])
            _, whole, bounds, start, end, kind = self._tokens(texts)
        pieces, last, grown = [], 0, []
        for s, e in zip(start[kind].tolist(), end[kind].tolist()):
            x = self._decode(whole[s:e])
            pieces += [whole[last:s], x]
            last = e
            grown.append(len(x) - (e - s))
        pieces.append(whole[last:])
        whole = "".join(pieces)
        shift = np.concatenate([[0], np.cumsum(grown, dtype=np.int64)])[np.searchsorted(start[kind], bounds, side="left")]
        cut = (bounds + shift).tolist()
        return [whole[a : b - 1] for a, b in zip(cut, cut[1:])]

    @staticmethod
    def _tokens(texts: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts that may hold a chain of single characters; the texts joined, their bounds, their tokens, and which of these to restore."""
        whole = "\x00".join(texts) + "\x00"
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _class_of(points)
        part = (kinds & 1).astype(bool)
        edge = np.diff(part.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return [], whole, bounds, start, end, np.zeros(0, bool)
        trigger = (kinds & 8).astype(bool)
        trigger[1:] |= (points[1:] == points[:-1]) & (kinds[1:] & 2).astype(bool)
        some = lambda x: np.concatenate([[0], np.cumsum(x)])
        triggers, signs = some(trigger), some((kinds & 4).astype(bool))
        kind = (end - start > 1) & (triggers[end] > triggers[start]) & (signs[end] > signs[start])
        row = np.searchsorted(bounds, start, side="right") - 1
        one = end - start == 1
        chain = np.flatnonzero(one[:-2] & one[1:-1] & one[2:] & (row[:-2] == row[2:])) if len(one) > 2 else np.empty(0, np.int64)
        return np.unique(row[chain]).tolist(), whole, bounds, start, end, kind


def features(text: str) -> tuple[set[str], list[set[str]]]:
    words = set(_WORD.findall(text.lower()))
    return words, [{w[:n] for w in words if len(w) > n} for n in PREFIXES]


@dataclass
class Model:
    """Weights of words and of word beginnings, and the logistic curve over the evidence."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: list[dict[str, float]] = field(default_factory=lambda: [{} for _ in PREFIXES])
    slope: float = 0.0
    bias: float = -50.0

    def evidence(self, text: str) -> float:
        words, starts = features(text)
        found = [self.words[w] for w in words & self.words.keys()]
        for have, known in zip(starts, self.prefixes):
            found += [0.8 * known[p] for p in have & known.keys()]
        return sum(w * x for w, x in zip(TOP, sorted(found, reverse=True)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * evidence))))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, lm: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out fold, those of least hash of id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known, sample_rows, "doc_id").select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(lm)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(restore.batch(b.column(0).to_pylist()), pa.string()), pa.array(b.column(1).to_pylist(), pa.int32())], names=["text", "toxic"])

    rows = materialise(rows.mapInArrow(restored, "text string, toxic int"), "restored")  # read twice

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = (Counter(), Counter())

        def drained() -> pa.RecordBatch:
            keys = list(have[0].keys() | have[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([have[0][k] for k in keys], pa.int64()), pa.array([have[1][k] for k in keys], pa.int64())], names=["f", "clean", "toxic"])
            have[0].clear()
            have[1].clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, starts = features(text)
                into = have[1 if toxic else 0]
                into.update("w" + w for w in words)
                for n, p in zip(PREFIXES, starts):
                    into.update(f"{n}" + x for x in p)
                into[""] += 1
                if len(have[0]) + len(have[1]) > 100_000:
                    yield drained()
        yield drained()

    counts = rows.mapInArrow(counted, "f string, clean bigint, toxic bigint").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    both = counts.filter("f = ''").first()
    if both is None or not both["t"] or not both["c"]:
        return Model()
    n_clean, n_toxic = both["c"], both["t"]
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    z = weight / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.filter("f != ''").withColumns({"w": weight, "z": z}).filter((F.col("t") >= LEAST_SUPPORT) & (F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "f").limit(MOST_FEATURES)
    model = Model()
    for r in best.collect():
        into = model.words if r["f"][0] == "w" else model.prefixes[PREFIXES.index(int(r["f"][0]))]
        into[r["f"][1:]] = r["w"]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have[round(model.evidence(text) * 4), int(bool(toxic))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in have], pa.int32()), pa.array([k[1] for k in have], pa.int32()), pa.array(list(have.values()), pa.int64())], names=["e", "y", "n"])

    seen = [(r["e"] / 4, r["y"], r["n"]) for r in rows.mapInArrow(weighed, "e int, y int, n bigint").groupBy("e", "y").agg(F.sum("n").alias("n")).collect()]
    model.slope, model.bias = logistic(seen)
    discard(rows)
    return model


def logistic(seen: list[tuple[float, int, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Slope and bias of a logistic curve over ``(x, label, count)``, by Newton's method."""
    x, y, n = (np.array(c, float) for c in zip(*seen))
    a = np.array([0.0, math.log((n[y == 1].sum() + 1) / (n[y == 0].sum() + 1))])
    z = np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        grad = (z * (n * (y - p))).sum(1) - ridge * np.array([a[0], 0])
        hess = (z * (n * p * (1 - p))) @ z.T + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row."""
    docs = spread(docs.select("doc_id", "text"))
    lm = log_model(trigram_counts(docs))
    model = fit(docs, labels, lm, sample_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(lm)
        for b in batches:
            found = [model.evidence(t) for t in restore.batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(e) for e in found], pa.float64()), pa.array(found, pa.float64())], names=["doc_id", "score", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id bigint, score double, evidence double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
