"""Every query with a SQL twin gives the twin's rows."""

import pytest

from tabularium.plans import catalogue, printed  # noqa: F401, printed adds its queries


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(name, same_as_sql):
    got, want = same_as_sql(catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert got == want and got


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
