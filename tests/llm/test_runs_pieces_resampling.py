"""Periodic runs, pieces and resampling against brute force, libraries and SQL, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import periodic, pieces, resampling

ODD = "doc_id long, text string, ids string, `_row` int, rank int, score string, n_words int, `range` int"


def odd(spark, rows):
    """Documents with columns that clash with inner names."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "s", 3, 4) for i, t in rows], ODD)


def brute_runs(w, least=24, repeats=3):
    """Maximal stretches of every period; of periods that share a stretch the least is its own."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= repeats * q:
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, repeats * q)), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    k = rng.choice([1, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(rng.randrange(1, 90))]
    if rng.random() < 0.6:
        p, a = rng.randrange(1, 12), rng.randrange(0, 20)
        w = w[:a] + [w[i % p % len(w)] for i in range(rng.randrange(5, 60))] + w[a:]
    return w


def dense(w):
    known = {}
    return [known.setdefault(x, len(known)) for x in w]


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        w = repetitive(rng)
        for least in (24, 6):
            assert periodic.runs(dense(w), least) == brute_runs(w, least)
    assert periodic.runs([]) == [] and periodic.runs([0]) == []


def test_classes_are_those_of_equal_factors():
    """At every level the linked lists hold the positions of equal factors, in order."""
    rng = random.Random(6)
    for _ in range(60):
        w = [*dense(repetitive(rng)), 99]
        w = dense(w)
        c = periodic.Classes(w, len(w) // 3)
        while c.level < 12:
            want = {}
            for i in range(len(w)):
                want.setdefault(tuple(w[i : i + c.level]), []).append(i)
            for m in want.values():
                assert len({c.of[i] for i in m}) == 1 and [c.after[i] for i in m] == [*m[1:], -1] and [c.before[i] for i in m] == [-1, *m[:-1]]
            assert len({c.of[i] for i in range(len(w))}) == len(want)
            c.refine()


def test_small_halves_bound_the_work():
    """Each position leaves its class a logarithmic number of times, even in a text of one word."""
    for w in ([0] * 3000, [i % 700 for i in range(3000)], dense(repetitive(random.Random(7)) * 40)):
        moves = Counter()

        class Counted(periodic.Classes):
            def _leave(self, i):
                moves[i] += 1
                super()._leave(i)

        c = Counted([*w, max(w) + 1], len(w) // 3)
        while c.level < len(w) // 3:
            c.refine()
        assert sum(moves.values()) <= len(w) * (2 + math.log2(len(w)))


def brute_query(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a, n = g % len(w), len(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *told, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_odd_documents(spark):
    rng = random.Random(8)
    prose = lambda n, k=300: [f"w{rng.randrange(k)}" for _ in range(n)]
    one = prose(11)
    texts = [None, "", " \n\t", "one", "a " * 5000, " ".join(prose(40) + one * 4 + prose(30)), "\n".join(one * 3), " ".join(one * 2), "ä ö ü " * 40, "x y " * 11 + "x", " ".join(prose(3000)), " ".join(prose(50) * 3 + one * 5 + prose(50) + one * 5), "a b " * 30 + "c d " * 30]
    rows = list(enumerate(texts)) + [(k, " ".join(prose(rng.randrange(1, 400)))) for k in range(100, 300)] + [(5, texts[5]), (5, texts[5]), (None, texts[6]), (None, texts[10])]
    got = [tuple(r) for r in periodic.find_runs(odd(spark, rows), remodel=True).drop("n_words").collect()]
    key = lambda r: (str(r[0]), r[-1], r[-2])
    assert sorted(got, key=key) == sorted((brute_query(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10
    assert periodic.find_runs(odd(spark, []), remodel=True).collect() == []
    kept = periodic.find_runs(odd(spark, [(1, texts[5])]), keep=True).first()
    assert [tuple(r) for r in kept["runs"]] == brute_runs(texts[5].split()) and kept["n_words"] == len(texts[5].split())
    assert kept["collapsed"] == " ".join(texts[5].split()[:51] + texts[5].split()[84:])


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def odd_texts(rng, known):
    texts = ["", " ", "  a", "a b", "▁x", "a\0b", "中文\n\n😀", "<s> hi</s>", "a  b   c", "  x", "ﬁ Å", " " * 70 + "x" + " " * 33, "̀abc  def", "\n\n", "the " * 300]
    some = "abehtinors  ▁\n1.,éèюк中の😀"
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randrange(1, 12))).replace("▁", " ") for _ in range(600)]
    return texts + ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x3000, 0x9FFF)])) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


def test_pieces_are_the_librarys(library):
    rng, own = random.Random(9), pieces.loaded()
    for text in odd_texts(rng, sorted(own.made)):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True) and own.decode(np.array(ids)).decode() == library.decode(ids)
    for _ in range(1500):  # rows of ids that no text gives, bytes that are no letters included
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 0, 1]) for _ in range(rng.randrange(0, 12))]
        assert own.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_seams_by_undoing_are_those_of_merging():
    rng, own = random.Random(10), pieces.loaded()
    known = sorted(own.made)
    assert own.steady
    for _ in range(4000):
        a, b = rng.choice(known), rng.choice(known)
        if rng.random() < 0.5:  # cut a piece in two, so that many seams would be merged
            whole = rng.choice(known)
            k = rng.randrange(1, len(whole))
            a, b = whole[:k], whole[k:]
            if not {a, b} <= own.id.keys() or len(a) > 1 and a not in own.made or len(b) > 1 and b not in own.made:
                continue
        if a.strip("▁") or b.strip("▁"):
            assert own._undone(a, b) == (own.merged(a + b)[0] == [a, b])


def test_prefix_table_holds_the_last_piece_of_every_prefix():
    own = pieces.loaded()
    for part in ("▁unbelievable", "▁internationalisation", "▁▁▁▁▁the", "zzzzzzzz", "▁éèê中文"):
        table = own.prefix_table(part)
        assert [table[k] for k in range(1, len(part) + 1)] == [own.merged(part[:k])[0][-1] for k in range(1, len(part) + 1)]


def test_pieces_of_all_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in pieces.round_trip(docs).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        want = (len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids).encode())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (want[0], *(hashlib.sha256(x).hexdigest() for x in want[1:]))


def test_pieces_of_odd_documents(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x  y\n"), (4, "long " * 40_000 + "y" * 50_000)]
    docs = odd(spark, rows)
    coded = pieces.encode_documents(docs)
    want = sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in coded.collect()) == want
    plain = pieces.decode_documents(coded.withColumn("text", F.lit(1)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in plain.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.round_trip(odd(spark, [])).collect() == []


def brute_resampling(docs, target, percent=5, least=20):
    def words(t):
        t = (t or "").encode()
        t = bytes(b + 32 if 65 <= b <= 90 else b for b in t)
        return bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in t).split(b" ")

    def buckets(t):
        w = [x for x in words(t) if x]
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in buckets(x)[1]), Counter(b for x in target for b in buckets(x)[1])
    all_s, all_t = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(10_000)]
    rows = []
    for i, x in docs:
        n, f = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(order[: percent * len(order) // 100]):
        ranks.setdefault(tuple(r[:4]), []).append(k + 1)
    return sorted(((*r[:4], ranks[tuple(r[:4])].pop(0) if ranks.get(tuple(r[:4])) else None) for r in rows), key=str)


def test_resampling_of_odd_documents(spark, monkeypatch):
    """Against brute force, with texts in slices, runs and ranges of few rows, and one id that a third of all rows repeat."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('ABcdé')}{rng.randrange(40)}{rng.choice([' ', '-', chr(10), ', '])}" for _ in range(n))
    same = prose(60)
    rows = [(k, prose(rng.randrange(0, 120))) for k in range(400)] + [(7, same)] * 200 + [(None, prose(50)), (None, prose(50)), (500, None), (501, ""), (502, "-" * 50), (503, prose(20_000))]
    target = [prose(80) for _ in range(20)] + [None, ""]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, bucket int")
    docs = odd(spark, rows).repartition(7)
    want = brute_resampling(rows, target)
    for size, run, rng_rows in ((1_000_000, 250_000, 50_000), (97, 10, 5)):
        monkeypatch.setattr(resampling, "SLICE", size)
        monkeypatch.setattr(resampling, "RUN", run)
        monkeypatch.setattr(resampling, "RANGE", rng_rows)
        got = sorted((tuple(r) for r in resampling.resample(docs, bench).collect()), key=str)
        assert got == want and sum(r[4] is not None for r in got) > 20
    half = sorted((tuple(r) for r in resampling.resample(docs, bench, percent=50).collect()), key=str)
    assert half == brute_resampling(rows, target, 50)
    assert resampling.resample(odd(spark, []), bench).collect() == []
    none = resampling.resample(docs, bench.limit(0)).collect()
    assert sorted((tuple(r) for r in none), key=str) == brute_resampling(rows, [])
    assert all(r["rank"] is None for r in resampling.resample(docs.limit(19), bench).collect())


def test_ranges_that_miss_the_draw_are_cut_anew(spark, monkeypatch):
    """Where the sample says too little, ranges of the whole are cut, and the draw is still exact."""
    rows = spark.range(3000).select(F.col("id").alias("score"), F.col("id").alias("doc_id"), F.col("id").alias("_row"))
    monkeypatch.setattr(resampling, "RANGE", 20)
    monkeypatch.setattr(resampling, "bounded_sample", lambda df, n, *key: df.orderBy(F.desc("score")).limit(60))
    got = sorted(tuple(r) for r in resampling.drawn(rows, 3000, 300).collect())
    assert got == sorted((2999 - k, k + 1) for k in range(300))


def test_tournament_merges_runs():
    rng = random.Random(12)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(9), rng.randrange(9), rng.randrange(10**6)) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(resampling.merged(runs)) == sorted(x for r in runs for x in r)


def test_ranks_and_tokenizer_file_agree_on_all_documents(spark, small):
    """The ids that packing computes from ranks are those of the tokenizer file, for every document of the largest small table."""
    import os

    import pyarrow as pa

    from tabularium.llm import packing

    large = small.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{large if os.path.isdir(large) else small}/documents.parquet").select("text")

    def compared(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = packing.encoder(None)
        for b in batches:
            texts = b.column(0).to_pylist()
            bad = sum(ids != known.whole(t or "") for t, ids in zip(texts, known.encode(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)]), pa.array([bad])], names=["n", "bad"])

    got = docs.repartition(8).mapInArrow(compared, "n bigint, bad bigint").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    assert got["n"] == docs.count() and got["bad"] == 0
