import oracle
import pytest

import __spark_entry__ as entry
from latewing.catalog import CATALOG


@pytest.fixture(scope="module")
def connection(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(n for n, e in CATALOG.items() if e.sql))
def test_matches_sql(spark, small, connection, name):
    assert oracle.differences(CATALOG[name].run(spark, small), connection, CATALOG[name].sql) == []


def test_entry_registers_the_catalog():
    assert CATALOG.keys() <= entry.queries().keys()
    assert {n: e.sql for n, e in CATALOG.items() if e.sql}.items() <= entry.oracle_sql().items()


def test_some_categories_are_unseen(spark, small):
    assert entry.queries()["unseen_categories"](spark, small).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_training_query(spark, small):
    rows = {r["model"]: r for r in entry.queries()["train_predict"](spark, small).collect()}
    assert set(rows) == {"boosted_trees", "linear"}
    assert all(r["test_rows"] > 0 and r["test_rmse"] > 0 for r in rows.values())


def test_importance_query(spark, small):
    rows = entry.queries()["feature_importance"](spark, small).collect()
    assert sum(r["importance_percent"] for r in rows) == pytest.approx(100, abs=1e-3)
