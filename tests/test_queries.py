"""Every query against its SQL; those without SQL have a version in plain Python in test_brute_force.py."""

import pytest
from support import DATA, same_rows

from quarryspark.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(SQL[name]))


def test_others_have_a_brute_force_version():
    from test_brute_force import CHECKED

    assert set(QUERIES) - set(SQL) == set(CHECKED)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
