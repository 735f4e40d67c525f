"""Every registered query on the smallest tables, beside its SQL where there is one."""

import pytest

from tests.check_oracle import compare, connect
from venuelens.plans.oracle import oracle_sql
from venuelens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    result = compare(spark, db, SF, name)
    assert not result.startswith("FAIL"), result


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(QUERIES)


def test_lsh_recall(spark):
    exact = {(r.request_id, r.id) for r in QUERIES["knn_filtered"](spark, SF).select("request_id", "id").collect()}
    near = {(r.request_id, r.id) for r in QUERIES["knn_lsh"](spark, SF).select("request_id", "id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_minhash_recall(spark):
    cols = ("term", "kind", "value")
    best = lambda name: {tuple(r[c] for c in cols) for r in QUERIES[name](spark, SF).filter("rank = 1").collect()}
    exact = best("value_lookup")
    assert len(exact & best("value_lookup_lsh")) >= 0.9 * len(exact)
