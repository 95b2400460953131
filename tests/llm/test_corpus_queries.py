
import pytest

from tabularium.llm.queries import QUERIES, oracle_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(name, same_as_sql):
    got, want = same_as_sql(QUERIES[name], oracle_sql()[name])
    assert got == want and got


def test_pipeline_decisions(spark, small):
    """The pipeline's documents are those that every decision leaves; near duplicates are found by SQL over all pairs."""
    import duckdb

    import corpus_pipeline as p
    from tabularium.llm import decontaminate, jaccard, rules

    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    kept = docs.join(rules.judge(docs).filter("kept").select("doc_id"), "doc_id")
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    ones = {r[0] for r in con.execute(jaccard.ORACLE_SQL).fetchall() if r[1] == r[0]}
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(kept, bench).collect()}
    rows = p.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == ones - leaked and rows
    assert [n for n, _ in p.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]


def odd_documents(spark):
    """Nulls in every column, repeated rows, an empty and a very long text, and columns whose names the operators use themselves."""
    import random

    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    one, long = prose(120), prose(30_000)
    near = one.split()
    near[7] = "other"
    key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789+/") for _ in range(44))
    rows = [(1, one, "en", "s"), (2, one, "en", "s"), (3, " ".join(near), "en", None), (4, long, None, "s"), (5, None, "en", "s"), (6, "", None, None), (7, "too short", "en", "s"), (None, prose(90), "en", "s"), (None, prose(90), None, None), (8, prose(80) + " token=abcdefghijklmnop " + key, "de", "s"), (8, prose(40), "de", "s"), (9, prose(50), "en", "s"), (9, prose(10), "en", "s")]
    rows += [(k, prose(100), "en", "s") for k in range(20, 50)]
    dup = rows[-1]
    schema = "doc_id long, text string, lang string, source string, n_chars long, grp string, node int, _k string, kept int, label string, block int, length int, _gone int, d2 double"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "g", 1, "k", 0, "l", 2, 3, 4, 0.5) for r in [*rows, dup]], schema)


def test_pipeline_of_odd_documents(spark, small):
    import corpus_pipeline as p

    docs, had = odd_documents(spark), None
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns, name
        rows = docs.collect()
        ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None))
        if name == "quality rules":
            assert {1, 2, 3, 4, 8, 20} <= set(ids) and not {5, 6, 7} & set(ids) and ids.count(49) == 2 and ids.count(9) == 1
        elif name == "n-gram Jaccard join":
            assert 1 in ids and not {2, 3} & set(ids) and ids.count(49) == 1 and ids.count(8) == 2 and sum(r["doc_id"] is None for r in rows) == 2
        elif name == "secret scans":
            assert len(rows) == len(had)
            masked = next(r for r in rows if r["doc_id"] == 8 and "<SECRET>" in r["text"])
            assert "abcdefghijklmnop" not in masked["text"] and masked["n_chars"] == len(masked["text"])
        had = rows
    packed = p.STAGES[-1][1](spark, docs, small).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(had) and {r["doc_id"] for r in packed} == {r["doc_id"] for r in had}


def test_pipeline_of_nothing(spark, small):
    import corpus_pipeline as p

    docs = odd_documents(spark).limit(0)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() == 0
    assert p.STAGES[-1][1](spark, docs, small).count() == 0
