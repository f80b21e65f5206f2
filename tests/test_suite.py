"""Every registered query equals its SQL on the smallest driver tables."""

import pytest

from suite import check
from suite.oracles import sql
from suite.queries import REGISTRY


@pytest.fixture(scope="module")
def database(sf_dir):
    return check.database(sf_dir)


@pytest.fixture(scope="module")
def statements():
    return sql()


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, sf_dir, database, statements, name):
    assert check.compare(REGISTRY[name](spark, sf_dir), database, statements[name]) is None


def test_results_do_not_depend_on_shuffle_partitions(spark, sf_dir):
    def rows(name):
        return sorted(map(str, REGISTRY[name](spark, sf_dir).collect()))

    names = ["eligible_files_capped", "search_sparse", "upsert_batches", "repo_latest"]
    before = {n: rows(n) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {n: rows(n) for n in names} == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry(spark, sf_dir):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
