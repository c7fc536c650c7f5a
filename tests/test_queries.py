"""Every query with SQL gives the same rows on both engines; the others run and are not empty."""

import pytest
from oracle_check import compare, connect

from stayline.plans.catalog import QUERIES
from stayline.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert compare(spark, duck, sf_dir, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    for row in rows[:1]:
        if "roc_auc" in row:
            assert 0.6 < row["roc_auc"] <= 1
        if "n_same" in row:
            assert row["n_same"] == row["n_rows"] == 150


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n]
