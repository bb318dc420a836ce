"""Every query beside its SQL twin, on the smallest tables."""

import pytest

from checks.compare import connect, differences
from checks.oracle import oracles
from checks.queries import QUERIES, registry

SF_DIR = "/root/testdata/sf0.001"
SQL = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"train_pairs", "classify_pairs", "predict_relations"}


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, con, name):
    n, found = differences(registry()[name](spark, SF_DIR), con, SQL[name])
    assert not found
    assert n > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_relations_are_predicted_for_every_article(spark):
    articles = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    got = registry()["predict_relations"](spark, SF_DIR).select("pmid").distinct().count()
    assert got == articles
