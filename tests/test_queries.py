"""Every query of the core against its SQL, or against its shape where there is none."""

import pytest
from oracle import FOLDER, check

from tallyloom.plans import longitudinal, tabular, tabular_sql

QUERIES = tabular.QUERIES | longitudinal.QUERIES
SQL = tabular.SQL | longitudinal.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


@pytest.mark.parametrize(("name", "windows"), [("rolling_measurements_full", ["full"]), ("rolling_measurements_all", tabular.WINDOWS)])
def test_windows_over_measurements(spark, name, windows):
    check(spark, QUERIES[name], tabular_sql._each(windows, base=tabular_sql._MEASURED))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
