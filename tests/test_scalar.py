"""Scalar functions and cleaning on hand-made edge rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.functions import json_body as J, scalar as S
from tallyrisk.operators import clean as C


def column(df, c="x"):
    return [r[c] for r in df.select(c).collect()]


def test_zero_and_unreadable_denominators_give_null(spark):
    df = spark.createDataFrame([("1", "0"), ("0", "0"), (None, "1"), ("x", "1"), ("6", "4")], "a STRING, b STRING")
    assert column(df.select(S.safe_ratio("a", "b").alias("x"))) == [None, None, None, None, 1.5]


def test_null_category_survives_the_junk_filter(spark):
    df = spark.createDataFrame([("F",), ("M",), ("XNA",), (None,)], "g STRING")
    assert sorted(column(df.where(S.not_value("g", "XNA")), "g"), key=str) == ["F", "M", None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (15.0,)], "d DOUBLE")
    assert column(df.select(S.positive_part("d").alias("x"))) == [None, 0.0, 15.0]


def test_infinite_values_become_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (2.0,), (None,)], "d DOUBLE")
    assert column(df.select(S.finite_or_null("d").alias("x"))) == [None, None, None, 2.0, None]


@pytest.mark.parametrize("years,bucket", [(26.9, 1), (27, 2), (40, 3), (50, 4), (65, 5), (99, 0)])
def test_age_buckets(spark, years, bucket):
    df = spark.createDataFrame([(-years * 365.0,)], "d DOUBLE")
    assert column(df.select(S.age_bucket("d").alias("x"))) == [bucket]


def test_age_bucket_of_null_is_zero(spark):
    assert column(spark.createDataFrame([(None,)], "d DOUBLE").select(S.age_bucket("d").alias("x"))) == [0]


def test_monday_is_zero(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS t")
    row = S.date_parts(df).first()
    assert (row["t_year"], row["t_month"], row["t_dayofweek"]) == (2024, 1, 0)


ROWS = [(1.0, 2.0, 4.0, 9.0, 3.5), (None, 2.0, None, 7.0, 1.0), (None,) * 5, (3.0, 3.0, 3.0, 3.0, 3.0), (None, None, 5.0, None, None)]


def test_rowwise_statistics_match_pandas(spark):
    cols = list("abcde")
    df = spark.createDataFrame(ROWS, ", ".join(f"{c} DOUBLE" for c in cols))
    got = df.select(
        S.row_sum(cols).alias("sum"), S.row_product(cols).alias("prod"), S.row_min(cols).alias("min"), S.row_max(cols).alias("max"),
        S.row_mean(cols).alias("mean"), S.row_median(cols).alias("median"), S.row_variance(cols).alias("var"), S.row_kurtosis(cols).alias("kurt"),
    ).toPandas()
    frame = pd.DataFrame(ROWS, columns=cols, dtype=float)
    for name in got.columns:
        want = getattr(frame, name)(axis=1)
        pd.testing.assert_series_equal(got[name].astype(float), want.astype(float), check_names=False)


def test_weighted_sum_propagates_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a DOUBLE, b DOUBLE")
    assert column(df.select(S.row_weighted_sum({"a": 2, "b": 3}).alias("x"))) == [8.0, None]


def test_names_are_cleaned_and_kept_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a b` INT, `a-b` INT, ` c%` INT")
    assert S.clean_names(df).columns == ["a_b", "a_b_2", "c"]
    assert S.clean_names(df, "delete").columns == ["a_b", "ab", "_c"]


BODIES = [
    '{"n": 1, "f": 2.5, "yes": true, "text": "5", "none": null, "deep": {"x": 1}}',
    '{"features": {"b": 2, "a": false, "t": "x"}, "n": 7}',
    "[1, 2]",
    "{broken",
    "",
    '{"features": [1], "n": 3}',
]


def test_feature_maps(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)], "i INT, body STRING")
    got = {r["i"]: r["m"] for r in df.select("i", J.feature_map(J.parsed("body")).alias("m")).collect()}
    assert got == {0: {"f": 2.5, "n": 1.0, "yes": 1.0}, 1: {"a": 0.0, "b": 2.0}, 2: {}, 3: {}, 4: {}, 5: {"n": 3.0}}


def test_feature_map_limit_is_in_key_order(spark):
    df = spark.createDataFrame([('{"c": 1, "a": 2, "b": 3}',)], "body STRING")
    assert df.select(J.feature_map(J.parsed("body"), 2).alias("m")).first()["m"] == {"a": 2.0, "b": 3.0}


def test_hash_ignores_key_order_and_spaces(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{ "b":"x","a":1 }',), ('{"a": 2, "b": "x"}',), ("[1]",), ("[2]",), ("{bad",), ("",)], "body STRING")
    h = column(df.select(J.payload_hash(F.col("body")).alias("x")))
    assert h[0] == h[1] != h[2] and h[3] == h[4] and h[5] not in h[:5] and h[6] is None


def test_keys_are_sorted_and_only_of_objects(spark):
    df = J.with_body_columns(spark.createDataFrame([('{"b": 1, "a": {"z": 1}}',), ("[1]",), ("{x",)], "body STRING"))
    assert column(df, "payload_keys") == [["a", "b"], None, None]


REQUESTS = [
    (35, 50000.0, 12000.0, 1200.0, 6.0, 3.0, None),
    (-5, 50000.0, 12000.0, 1200.0, 6.0, 3.0, "age"),
    (-1, 1000.0, 500.0, 50.0, 2.0, 2.0, "age"),
    (30, 0.0, 500.0, 50.0, 2.0, 2.0, "income"),
    (121, 1.0, 1.0, 1.0, -1.0, 1.0, "age,employment_years"),
    (None, 1.0, 1.0, 1.0, 0.0, 1.0, "age"),
]


def test_request_validation(spark):
    df = spark.createDataFrame(REQUESTS, "age INT, income DOUBLE, credit_amount DOUBLE, annuity DOUBLE, employment_years DOUBLE, family_members DOUBLE, want STRING")
    for r in C.validate(df).collect():
        assert (",".join(r["failed_fields"]) or None) == r["want"]
        assert r["error"] == ("validation_error" if r["want"] else None)


def test_narrow_types(spark):
    df = spark.createDataFrame([(127, 128, 40000, 1.5, None), (-128, 0, -40000, 2.0, None)], "a BIGINT, b BIGINT, c BIGINT, d DOUBLE, e BIGINT")
    types = C.fit_narrow_types(df)
    assert types == {"a": "byte", "b": "short", "c": "int", "d": "float"}
    assert sorted(C.narrow(df, types).toPandas()["c"]) == [-40000, 40000]


def test_align_adds_orders_and_fills(spark):
    df = spark.createDataFrame([(1, "7", None)], "id INT, b STRING, a DOUBLE")
    row = C.align(df, ["a", "b", "c", "d"], {"a": 0.5, "c": 9.0}, keep=["id"]).first()
    assert row.asDict() == {"id": 1, "a": 0.5, "b": 7.0, "c": 9.0, "d": 0.0}


def test_unused_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 2, 3)], "SK_ID_CURR INT, FLAG_DOCUMENT_2 INT, FLAG_DOCUMENT_3 INT")
    assert C.drop_unused(df).columns == ["SK_ID_CURR", "FLAG_DOCUMENT_3"]
    assert C.feature_columns(df) == ["FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3"]
