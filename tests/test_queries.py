"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
ORACLE = {name: e.sql for name, e in entry.REGISTRY.items() if e.sql is not None}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    text, _, good = compare.check(spark, con, SF, name, entry.queries()[name], ORACLE[name])
    assert good, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "driver_finish_ewma" in df.columns


def test_names_follow_the_rules():
    names = set(entry.REGISTRY)
    assert "pipeline" not in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
    assert names <= set(entry.queries()) and set(ORACLE) <= names
