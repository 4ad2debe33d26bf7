import pytest
from tests import oracle
from tests.conftest import SF

from lumenfold.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    n, want, different = oracle.differences(QUERIES[name](spark, SF), con, SQL[name])
    assert n == want and not different


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_agree(spark):
    """Count, listing and facets see the same rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {r["source"]: r["n"] for r in QUERIES["count_matching"](spark, SF).collect()}
    assert sum(counts.values()) == docs.count() == sum(r["n"] for r in QUERIES["facets_by_key"](spark, SF).collect())
    assert QUERIES["filter_listing"](spark, SF).where(F.col("source") != "src0").count() == 0
