"""Every query over request traffic against its SQL in another engine."""

import pytest

from tests.comparing import SMALL, duck, duck_rows, spark_rows
from wakeline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(duck().sql(SQL[name]))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_llm_is_imported_by_nothing_else():
    import pathlib

    for p in pathlib.Path(registry.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
