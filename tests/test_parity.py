import parity
import pytest

from scriptorium.plans import registry

WITH_SQL = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_duckdb(spark, name):
    parity.same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_lsh_finds_what_the_exact_join_finds(spark):
    exact = {(r.x, r.y) for r in registry.queries()["near_duplicates"](spark, parity.SF).collect()}
    found = {(r.x, r.y) for r in registry.queries()["near_duplicates_lsh"](spark, parity.SF).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
