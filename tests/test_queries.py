"""Registered queries run on the smallest tables and equal their SQL; the rest is checked by check_queries.py."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["joint_split_cells", "inner_split_cells", "candidate_funnel", "ranked_draws", "fold_robust_transform", "cross_fit_predictions", "vocabulary_scores",
          "unit_cycle_within_record", "permutation_null", "direct_weights", "sequence_join_proof", "run_ledger_errors", "table_digest", "text_normal_forms",
          "role_inputs", "near_duplicate_documents", "closest_text_pair", "cosine_boundary", "digest_verification", "digest_changed_rows",
          "logistic_fold_solutions", "logistic_fold_models", "item_clusters", "two_parameter_fit", "slice_location"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def test_contract(spark):
    assert contract.entry(spark).count() == 30
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, db, name):
    got, want = contract.queries()[name](spark, FOLDER).toPandas(), db.sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_unknown_roles(spark):
    from heldout.operators import probes as pb

    df = spark.createDataFrame([("a", [1]), ("b", [2]), (None, [3])], "role string, x array<int>")
    parts = {"a": ["x"]}
    got = [tuple(r) for r in df.select("role", pb.role_input("role", parts), pb.role_reason("role", parts)).collect()]
    assert got == [("a", [1], None), ("b", None, "ROLE_NOT_REGISTERED"), (None, None, "ROLE_NOT_REGISTERED")]
    assert pb.require_roles(df.filter("role = 'a'"), "role", parts).count() == 1
    with pytest.raises(Exception, match="no inputs are registered for the role"):
        pb.require_roles(df, "role", parts).collect()
