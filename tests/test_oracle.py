"""Every query with SQL gives the rows DuckDB gives, plainly and with the skew paths forced."""

from __future__ import annotations

import pytest
from check_oracle import ORDERED, compare, oracle_connection

import __spark_entry__ as entry

SQL = entry.oracle_sql()

# queries whose plans have a separate path for heavy groups or large lookups
CROWDED = [
    "stay_history", "win_dense_code_index", "join_left_dimension", "join_left_fanout_map", "join_left_normalized_key",
    "join_semi_split", "join_anti_split", "join_code_vector_lookup", "default_code_label", "stratified_group_split",
    "agg_median", "agg_describe", "agg_boxplot_stats", "agg_patient_summary", "build_sequences", "lag_features",
    "metric_roc_auc", "subgroup_classification", "target_encode", "win_bh_adjust", "impute_median",
    "agg_percentiles_by_group", "code_dictionary", "count_vectors", "differential_codes",
    "decayed_history", "pad_batches", "target_encode_cross_fitted", "permutation_importance_linear_auc",
]


@pytest.fixture(scope="module")
def con():
    return oracle_connection("/root/testdata/sf0.001")


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, folder, key):
    assert compare(entry.queries()[key](spark, folder), con, SQL[key], key in ORDERED) == ""


@pytest.mark.parametrize("key", CROWDED)
def test_matches_sql_when_crowded(spark, con, folder, crowded, key):
    assert compare(entry.queries()[key](spark, folder), con, SQL[key]) == ""


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
