import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TABULARIUM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tabularium.session import local_session, ship

    session = local_session(8, 8, "6g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Rows of a query and of its SQL twin, as sorted lists."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{small}/{name}')")

    def both(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        got = [tuple(r[c] for c in cols) for r in df.collect()]
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        return sorted(got, key=key), sorted(want, key=key)

    return both
