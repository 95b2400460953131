"""Secrets: patterns, and a battery of randomness tests under false-discovery control.

Patterns (kinds ``assign``, ``access``, ``hex``) give the base spans: the whole
match, in code points. The battery then looks at runs of 20 or more characters
of ``[A-Za-z0-9+/_-]`` with a letter or digit that no base span overlaps. The
smallest fitting alphabet is the encoding; against it go a chi-squared test of
uniformity, a runs test, a serial-correlation test and a test of letter pairs
against those of common words, joined by Fisher's method. Digits that separators part are judged without these.

The null is no run under test: the ordinary words of every text (pieces of
letters alone in runs of under 20 characters) are joined to windows of each
length class in the form of each family of encodings: one case, both cases, with
a number, with separators; numbers are joined for digits. The same windows over
a fixed text of common words are added, so that a small corpus has a null too.
Words look random the more easily the shorter they are, so a class is judged by
the windows of its length and a little under. In each family and class the
Benjamini-Hochberg rule picks the discoveries (kind ``random``).

Defined cases: null text is empty (no spans; the digest is that of the empty
string); repeated rows are scanned each; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import materialise, spread
from tabularium.llm.textkernel import row_batches, text_bytes

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 12, 18, 16, 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
FDR = 0.05
BINS = 64

_DIGITS, _UP, _LOW = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An encoding is the smallest alphabet, the first of these among equals, that holds all of a run's characters.
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", "234567" + _UP, _DIGITS + _LOW, _DIGITS + _UP, _DIGITS + _UP + _LOW, _DIGITS + _UP + _LOW + "+/", "-" + _DIGITS + _UP + "_" + _LOW, "+-/" + _DIGITS + _UP + "_" + _LOW, _LOW, _UP, _UP + _LOW, _DIGITS)
_PLACE = np.full((len(ALPHABETS), 256), -1, np.int16)
for _k, _a in enumerate(ALPHABETS):
    _PLACE[_k, np.frombuffer(_a.encode(), np.uint8)] = np.arange(len(_a))
_HEXES = np.zeros(256, bool)
_HEXES[np.frombuffer((_DIGITS + "abcdef").encode(), np.uint8)] = True
_RUNS = np.zeros(256, bool)
_RUNS[np.frombuffer(ALPHABETS[8].encode(), np.uint8)] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[np.frombuffer(ALPHABETS[5].encode(), np.uint8)] = True
_BY_SIZE = sorted(range(len(ALPHABETS)), key=lambda k: len(ALPHABETS[k]))

#: Families of encodings that have a null in common. Ordinary words do not fit hexadecimal, so it is judged with the words of one case.
ONE_CASE, BOTH_CASES, ONE_CASE_DIGITS, BASE32, BOTH_CASES_DIGITS, SEPARATED, NUMBERS = range(7)
FAMILIES = 7
_FAMILY = np.array([ONE_CASE_DIGITS, ONE_CASE_DIGITS, BASE32, ONE_CASE_DIGITS, ONE_CASE_DIGITS, BOTH_CASES_DIGITS, SEPARATED, SEPARATED, SEPARATED, ONE_CASE, ONE_CASE, BOTH_CASES, NUMBERS])
_NULL_ENCODING = np.array([9, 11, 3, 2, 5, 7, 12])
#: Length classes of the null: the shortest of each class is taken, as shorter windows look more random. Longer runs are judged by the last.
LAST_CLASS, REACH = 28, 4
LENGTHS = [math.ceil(2 ** (c / 4)) for c in range(17, LAST_CLASS + 1)]
_NUMBER_LENGTHS = [5, 6, 7, 8, 10, 12, 14, 17, *LENGTHS]
_CYCLE = np.array([(n, f) for n in LENGTHS for f in range(NUMBERS)])
_AT = np.concatenate([[0], np.cumsum(_CYCLE[:, 0])])
#: Words of the fixed text.
_COMMON = (
    "the of and to in is for that with on as are this by from be or have not you all can more when one use new time user name file path data page home index image post list item view test main config server client value "
    "number system report update default product search system-wide download version message content account public module service project manager library example information development international "
    "der die und das nicht eine auch werden zwischen arbeit le les des une pour dans avec plus cette entre el los por para como pero sobre desde hasta"
).replace("-", " ").split()


def _pair_scores() -> np.ndarray:
    """Log odds of a letter after another in common words against chance; smoothed."""
    n = np.full((26, 26), 0.5)
    for w in _COMMON:
        for a, b in zip(w, w[1:]):
            n[ord(a) - 97, ord(b) - 97] += 1
    return np.log(n / n.sum() * 676)


_PAIRS = np.zeros((256, 256))
for _a in (65, 97):
    for _b in (65, 97):
        _PAIRS[_a : _a + 26, _b : _b + 26] = _pair_scores()
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def _chance(alphabet: str) -> tuple[float, float, float]:
    """Mean and variance of a pair's score, and covariance of neighbouring pairs, for random letters of an alphabet."""
    letters = [ord(c) for c in alphabet if c.isalpha()]
    x = _PAIRS[np.ix_(letters, letters)]
    return (0.0, 1.0, 0.0) if not letters else (x.mean(), x.var(), float(((x.mean(0) - x.mean()) * (x.mean(1) - x.mean())).mean()))


_CHANCE = np.array([_chance(a) for a in ALPHABETS])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out


def hex_spans(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]


def has_run(data: np.ndarray, bounds: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
    """For each row, whether ``least`` bytes of a class stand in a row."""
    sums = np.zeros(len(data) + 1, np.int32)
    np.cumsum(known[data], out=sums[1:])
    out = np.zeros(len(bounds) - 1, bool)
    if len(data) >= least:
        at = np.flatnonzero(sums[least:] - sums[:-least] == least)
        row = np.searchsorted(bounds[1:], at, side="right")
        out[row[at + least <= bounds[1:][row]]] = True
    return out


def _tail(z2: np.ndarray) -> np.ndarray:
    """Two-sided tail of a normal deviate, from its square."""
    return np.array([math.erfc(math.sqrt(v / 2)) for v in z2.tolist()])


def battery(runs: list[str], encodings: np.ndarray) -> np.ndarray:
    """Fisher's combined p-value of the four tests for each run under its encoding; near 0: not random."""
    return battery_of_bytes(np.frombuffer("".join(runs).encode("latin-1"), np.uint8), np.array([len(r) for r in runs], np.int64), encodings)


def battery_of_bytes(data: np.ndarray, n: np.ndarray, encodings: np.ndarray) -> np.ndarray:
    """The same for runs of lengths ``n`` that stand one after the other."""
    if not len(n):
        return np.empty(0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    size = np.array([len(a) for a in ALPHABETS])[encodings]
    x = _PLACE[encodings[row], data].astype(np.int64)
    cells = np.clip(n // 5, 2, size)
    counts = np.bincount(row * 80 + x * cells[row] // size[row], minlength=80 * len(n)).reshape(len(n), 80)
    k = np.arange(80)
    lo, hi = -(-k * size[:, None] // cells[:, None]), -(-(k + 1) * size[:, None] // cells[:, None])
    expected = np.where(k < cells[:, None], (hi - lo) * (n / size)[:, None], 1)
    chi = np.where(k < cells[:, None], (counts - expected) ** 2 / expected, 0).sum(1)
    df = cells - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    p_chi = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z.tolist()])
    high = x >= size[row] / 2
    inner = np.ones(len(x), bool)
    inner[at] = False
    turns = np.bincount(row[1:], weights=(high[1:] != high[:-1]) & inner[1:], minlength=len(n))
    p_runs = _tail((turns - (n - 1) / 2) ** 2 / ((n - 1) / 4))
    y = (x - (size[row] - 1) / 2) / np.sqrt((size[row].astype(float) ** 2 - 1) / 12)
    serial = np.bincount(row[1:], weights=np.where(inner[1:], y[1:] * y[:-1], 0), minlength=len(n))
    p_serial = _tail(serial**2 / (n - 1))
    pair = inner[1:] & _LETTERS[data[1:]] & _LETTERS[data[:-1]]
    mean, var, cov = _CHANCE[encodings].T
    pairs = np.bincount(row[1:], weights=pair, minlength=len(n))
    triples = np.bincount(row[2:], weights=pair[1:] & pair[:-1], minlength=len(n))
    score = np.bincount(row[1:], weights=np.where(pair, _PAIRS[data[:-1], data[1:]], 0), minlength=len(n))
    z = (score - pairs * mean) / np.sqrt(np.maximum(pairs * var + 2 * triples * cov, 1))
    p_pairs = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z.tolist()])
    half = -np.log(np.clip(np.stack([p_chi, p_runs, p_serial, p_pairs]), 1e-30, 1)).sum(0)
    return np.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6)


def bin_of(p: np.ndarray) -> np.ndarray:
    """Bin 0: least random. Fine towards 1, logarithmic towards 0."""
    return np.clip(BINS - 1 + np.ceil(4 * np.log2(np.clip(p, 1e-30, 1))), 0, BINS - 1).astype(np.int64)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(4 * np.log2(n)), 63).astype(np.int64)


def encoding_of(run: str) -> int:
    codes = np.frombuffer(run.encode("latin-1"), np.uint8)
    return next(k for k in _BY_SIZE if (_PLACE[k, codes] >= 0).all())


def candidates(text: str, own: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """``(start, end, what the battery judges)`` of the runs outside the base spans."""
    for m in RUN.finditer(text):
        run = m[0]
        digits = "".join(c for c in run if c.isdigit())
        if (digits or any(c.isalpha() for c in run)) and not any(s < m.end() and e > m.start() for s, _, e in own):
            yield m.start(), m.end(), run if any(c.isalpha() for c in run) else digits


def cells_of(data: np.ndarray, n: np.ndarray, encodings: np.ndarray) -> np.ndarray:
    """Family, length class and bin of each run, as one number."""
    return (_FAMILY[encodings] * 64 + length_class(n)) * BINS + bin_of(battery_of_bytes(data, n, encodings))


def judged(runs: list[str]) -> np.ndarray:
    if not runs:
        return np.empty(0, np.int64)
    return cells_of(np.frombuffer("".join(runs).encode("latin-1"), np.uint8), np.array([len(r) for r in runs]), np.array([encoding_of(r) for r in runs]))


def _marked(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of some disjoint intervals."""
    steps = np.zeros(size + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).astype(bool)


def null_histogram(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of the cells of all null windows over some texts. It is a sum over the texts, in whatever batches they come."""
    out = np.zeros(FAMILIES * 64 * BINS, np.int64)
    size = len(data)
    if not size:
        return out
    first = np.zeros(size + 1, bool)
    first[bounds] = True

    def pieces(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.concatenate([[False], mask[:-1]]), np.concatenate([mask[1:], [False]])
        return np.flatnonzero(mask & (first[:-1] | ~before)), np.flatnonzero(mask & (first[1:] | ~after)) + 1

    s, e = pieces(_RUNS[data])
    long = e - s >= LEAST_RUN
    s, e = pieces(_ALNUM[data] & ~_marked(s[long], e[long], size))
    figures = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    figures = figures[e] - figures[s]
    begins = np.zeros(size, bool)
    begins[s] = True
    for kept, tally in ((figures == 0, _word_windows), (figures == e - s, _number_windows)):
        at = np.flatnonzero(_marked(s[kept], e[kept], size))
        for part, n, encodings in tally(data[at], begins[at], np.searchsorted(at, bounds)):
            out += np.bincount(cells_of(part, n, encodings), minlength=len(out))
    return out


def _within(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _word_windows(letters: np.ndarray, begins: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's letters are cut into windows of all lengths and forms in turn, from a turn on that its size gives."""
    m = np.diff(bounds)
    turn = m * 29 % len(_CYCLE)
    end = _AT[turn] + m
    many = end // _AT[-1] * len(_CYCLE) + np.searchsorted(_AT, end % _AT[-1], side="right") - 1 - turn
    turns = np.repeat(turn, many) + _within(many)
    inside = turns // len(_CYCLE) * _AT[-1] + _AT[turns % len(_CYCLE)] - np.repeat(_AT[turn], many)
    starts = np.repeat(bounds[:-1], many) + inside
    for i in range(0, len(turns), 8192):
        k, start, mixed = turns[i : i + 8192], starts[i : i + 8192], inside[i : i + 8192] * 7919 // 64 + turns[i : i + 8192]
        n, fam = _CYCLE[k % len(_CYCLE)].T
        sort, figures = mixed % 3, np.where((fam == ONE_CASE) | (fam == BOTH_CASES) | ((fam == SEPARATED) & (mixed // 3 % 2 == 0)), 0, 1 + mixed // 6 % 4)
        j, f = _within(n), np.repeat(fam, n)
        at = np.repeat(start, n) + j
        c, opens = letters[at] | 32, begins[at] | (j == 0)
        number = (letters[at].astype(np.int64) * 7 + letters[at - 1] * 3 + j) % 10
        # A separator takes the place of a word's first letter; the next one is a capital in one window of three.
        parted = (f == SEPARATED) & opens & (j > 0)
        capital = (f == BASE32) | (((f == BOTH_CASES) | (f == BOTH_CASES_DIGITS)) & opens) | ((f == SEPARATED) & np.repeat(sort == 2, n) & np.concatenate([[False], parted[:-1]]))
        c = np.where(capital, c & 0xDF, c)
        c = np.where(parted, np.frombuffer(b"-_/", np.uint8)[np.repeat(sort, n)], c)
        c = np.where(j >= np.repeat(n - figures, n), np.where(f == BASE32, 50 + number % 6, 48 + number), c).astype(np.uint8)
        yield c, n, np.where((fam == SEPARATED) & (sort == 2), 6, np.where((fam == SEPARATED), 7, _NULL_ENCODING[fam]))


def _number_windows(digits: np.ndarray, begins: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's numbers are joined, again from the first where they are too few."""
    m = np.diff(bounds)
    size = np.array(_NUMBER_LENGTHS)[m * 7 % len(_NUMBER_LENGTHS)]
    many = np.where(m > 0, -(-m // size), 0)
    for i in range(0, many.sum(), 8192):
        row = np.repeat(np.arange(len(m)), many)[i : i + 8192]
        n, start = size[row], _within(many)[i : i + 8192] * size[row]
        yield digits[np.repeat(bounds[row], n) + (np.repeat(start, n) + _within(n)) % np.repeat(m[row], n)], n, np.full(len(n), 12)


@cache
def fixed_null() -> np.ndarray:
    """The null over common words with a number now and then: about 200 windows of each form and length."""
    rng = random.Random(0)
    number = lambda: rng.choice([str(rng.randrange(1, 100)), str(rng.randrange(1950, 2030)), f"{rng.randrange(1950, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", str(rng.randrange(1000) * 100)])
    text = " ".join(number() if rng.random() < 0.08 else rng.choice(_COMMON) for _ in range(200 * int(_AT[-1]) // 5))
    rows = pa.array([text[i : i + 6000 + i % 1000] for i in range(0, len(text), 7000)])
    data, bounds = text_bytes(rows)
    return sum(null_histogram(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in row_batches(bounds))


def scan_table(docs: DataFrame) -> DataFrame:
    """A slim row a document: base spans and candidate runs with their cells; the null cells of a batch stand in its first row."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, cand array<struct<s:int,e:int,cell:int>>, nulls array<struct<c:int,n:bigint>>"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            data, bounds = text_bytes(texts)
            hexes, longs = has_run(data, bounds, _HEXES, LEAST_HEX), has_run(data, bounds, _RUNS, LEAST_RUN)
            null = np.zeros(FAMILIES * 64 * BINS, np.int64)
            for i, j in row_batches(bounds):
                null += null_histogram(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            spans, runs, owner = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                text = text or ""
                own = sorted(base_spans(text) + (hex_spans(text) if hexes[i] else []))
                spans.append(own)
                if longs[i]:
                    for start, end, run in candidates(text, own):
                        runs.append(run)
                        owner.append((i, start, end))
            cand: list[list] = [[] for _ in range(len(spans))]
            for (i, start, end), c in zip(owner, judged(runs).tolist()):
                cand[i].append({"s": start, "e": end, "cell": c})
            bins: list[list] = [[] for _ in range(len(spans))]
            if bins:
                bins[0] = [{"c": c, "n": int(null[c])} for c in np.flatnonzero(null).tolist()]
            kinds = [[sum(k == want for _, k, _ in own) for own in spans] for want in range(3)]
            base = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own) for own in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(k, pa.int64()) for k in kinds), pa.array(base, pa.string()), pa.array(cand, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("cell", pa.int32())]))), pa.array(bins, pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64())])))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "cand", "nulls"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(scanned, schema)


def discovery_bins(scans: DataFrame, q: float = FDR) -> dict[int, int]:
    """Family and length class to the least bin that is a discovery. The histograms have 7 x 64 x 64 cells at most."""
    null, cand = fixed_null().copy(), np.zeros(FAMILIES * 64 * BINS, np.int64)
    for r in scans.select(F.explode("nulls").alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("n")).collect():
        null[r["c"]] += r["n"]
    for r in scans.select(F.explode("cand.cell").alias("c")).groupBy("c").count().collect():
        cand[r["c"]] = r["count"]
    tail = lambda x: x.reshape(FAMILIES, 64, BINS)[..., ::-1].cumsum(-1)[..., ::-1]
    ordinary, found, out = tail(null), tail(cand), {}
    for fam in range(FAMILIES):
        for c in range(64):
            if not found[fam, c, 0]:
                continue
            top = min(c, LAST_CLASS)
            like = ordinary[fam, max(0, top - REACH + 1) : top + 1].sum(0)
            p = (1 + like) / (1 + like[0])
            good = np.flatnonzero((found[fam, c] > 0) & (p * found[fam, c, 0] <= q * found[fam, c]))
            if len(good):
                out[fam * 64 + c] = int(good[0])
    return out


def _spans(base: Column, cand: Column, least: dict[int, int]) -> Column:
    """All spans as ``kind:start:end``, by start and kind."""
    table = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv]) if least else F.create_map().cast("map<int,int>")
    hit = F.filter(cand, lambda c: (c["cell"] % BINS) >= F.coalesce(F.try_element_at(table, (c["cell"] / BINS).cast("int")), F.lit(BINS)))
    added = F.transform(hit, lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), F.concat_ws(":", F.lit("random"), c["s"], c["e"]).alias("t")))
    kind = lambda t: F.when(t.startswith("assign"), 0).when(t.startswith("access"), 1).otherwise(2)
    old = F.transform(F.filter(F.split(base, ","), lambda t: t != ""), lambda t: F.struct(F.split(t, ":")[1].cast("int").alias("s"), kind(t).alias("k"), t.alias("t")))
    return F.array_join(F.transform(F.array_sort(F.concat(old, added)), lambda x: x["t"]), ",")


def find_secrets(docs: DataFrame, q: float = FDR) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base, spans`` for every row."""
    scans = materialise(scan_table(docs), "secrets")
    spans = _spans(F.col("base"), F.col("cand"), discovery_bins(scans, q))
    out = scans.select("doc_id", "n_assign", "n_access", "n_hex", "base", spans.alias("spans"))
    return out.withColumn("n_random", F.size(F.filter(F.split("spans", ","), lambda t: t.startswith("random"))).cast("long"))


def query(docs: DataFrame) -> DataFrame:
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_random")


def redact(text: str | None, spans: str) -> str | None:
    """The text with every span, merged where they overlap, replaced by a mark."""
    if not text or not spans:
        return text
    out, last = [], 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (t.split(":") for t in spans.split(","))):
        if s >= last:
            out += [text[last:s], "<SECRET>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def redact_documents(docs: DataFrame, q: float = FDR) -> DataFrame:
    """The rows of ``docs`` with secrets masked in ``text`` and ``n_chars`` counted anew where it changed.

    The bounded thresholds go back over the texts, so no text is shuffled.
    """
    scans = materialise(scan_table(docs), "secrets")
    least = discovery_bins(scans, q)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column("text"))
            hexes, longs = has_run(data, bounds, _HEXES, LEAST_HEX), has_run(data, bounds, _RUNS, LEAST_RUN)
            texts = b.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text:
                    texts[i] = redact(text, ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in _all_spans(text, hexes[i], longs[i], least)))
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = spread(docs).mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _all_spans(text: str, hexes: bool, longs: bool, least: dict[int, int]) -> list[tuple[int, int, int]]:
    own = sorted(base_spans(text) + (hex_spans(text) if hexes else []))
    found = list(candidates(text, own)) if longs else []
    cells = judged([run for _, _, run in found]).tolist()
    return sorted(own + [(start, 3, end) for (start, end, _), c in zip(found, cells) if c % BINS >= least.get(c // BINS, BINS)])
