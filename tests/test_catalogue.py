import pytest

from eponym.plans import catalogue, services  # noqa: F401

from .oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), sf_dir, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["name", "alt_name"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_double_code_pairs_take_all_names(spark, sf_dir):
    from pyspark.sql import functions as F

    from eponym.functions import coders
    from eponym.sources import tables

    under = {}
    for r in tables.preferred(spark, sf_dir).select("name", coders.double_codes(F.col("name")).alias("codes")).collect():
        for c in set(r["codes"]) - {"", None}:
            under.setdefault(c, set()).add(r["name"])
    want = {(a, b) for names in under.values() for a in names for b in names if a != b}
    got = [tuple(r) for r in catalogue.QUERIES["double_code_pairs"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want
