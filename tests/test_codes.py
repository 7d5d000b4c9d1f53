"""Code dictionaries and sparse counts: any number of codes, none lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardline.operators import codes


@pytest.fixture(scope="module")
def many(spark):
    """50,000 codes; admission 0 has them all, the others a few, some more than once, some null."""
    own = spark.range(50_000).select(F.lit(0).cast("long").alias("hadm_id"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("ccs_code"))
    more = spark.createDataFrame([(1, "c00007"), (1, "c00007"), (1, None), (2, "c49999"), (2, "c00000"), (3, None)], "hadm_id long, ccs_code string")
    return own.unionByName(more)


def test_dictionary_numbers_every_code_in_order(spark, many):
    found = codes.code_dictionary(many)
    assert found.count() == 50_000
    assert found.where("CAST(substr(ccs_code, 2) AS BIGINT) <> ccs_index").count() == 0


def test_fifty_thousand_codes_as_sparse_rows(spark, many):
    rows = {r["hadm_id"]: r for r in codes.count_vectors(many, codes.code_dictionary(many)).collect()}
    assert rows[0]["indices"] == list(range(50_000)) and set(rows[0]["counts"]) == {1}
    assert (rows[1]["indices"], rows[1]["counts"], rows[1]["n_null"]) == ([7], [2], 1)
    assert rows[2]["indices"] == [0, 49_999] and (rows[3]["indices"], rows[3]["n_null"]) == ([], 1)


def test_codes_that_came_later_are_counted(spark, many):
    early = codes.code_dictionary(many.where("hadm_id = 1"))
    rows = {r["hadm_id"]: r for r in codes.count_vectors(many.where("hadm_id > 0"), early).collect()}
    assert rows[1]["n_unknown"] == 0 and (rows[2]["indices"], rows[2]["n_unknown"]) == ([], 2)


def test_sparse_features_are_vectors(spark, many):
    vectors = codes.count_vectors(many.where("hadm_id > 0"), codes.code_dictionary(many))
    rows = {r["hadm_id"]: r["features"] for r in codes.as_sparse_features(vectors, 50_000).collect()}
    assert rows[1].size == 50_000 and rows[1][7] == 2.0 and rows[2].indices.tolist() == [0, 49_999] and rows[3].numNonzeros() == 0
    got = {r["hadm_id"]: r["n"] for r in vectors.select("hadm_id", codes.count_at(7).alias("n")).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


def test_a_list_of_columns_loses_nothing(spark, many):
    rows = {r["hadm_id"]: tuple(r)[1:] for r in codes.count_pivot(many, ["c00000", "c00007"]).collect()}
    assert rows == {0: (1, 1, 49_998), 1: (0, 2, 1), 2: (1, 0, 1), 3: (0, 0, 1)}
    strict = codes.count_pivot(many.where("hadm_id = 1"), ["c00007"], other=None)
    with pytest.raises(Exception, match="code outside the list"):
        strict.collect()
    with pytest.raises(ValueError):
        codes.count_pivot(many, ["other"])
    assert codes.count_pivot(many.limit(0), ["a"]).count() == codes.count_vectors(many.limit(0), codes.code_dictionary(many.limit(0))).count() == 0
