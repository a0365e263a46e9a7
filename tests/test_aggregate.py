"""Aggregates, slices, windows and encoders on edge frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import aggregate as A, encode as E, joins as J, windows as W
from tallyrisk.session import settle

CREDITS = [
    (1, "Closed", 5.0, -10.0),
    (1, "Closed", None, -500.0),
    (2, "Active", None, -20.0),
    (2, "Active", None, -30.0),
    (3, "Active", 7.0, -1000.0),
    (None, "Active", 9.0, -1.0),
]


@pytest.fixture(scope="module")
def credits(spark):
    return spark.createDataFrame(CREDITS, "k INT, status STRING, amt DOUBLE, days DOUBLE")


@pytest.mark.parametrize("folded", [False, True])
def test_slices_tell_missing_from_empty(credits, folded):
    slices = {"ALL": F.lit(True), "ACTIVE": F.col("status") == "Active", "RECENT": F.col("days") >= -180}
    spec = {"amt": ["sum", "mean", "count", "size"]}
    got = A.sliced_stats(credits, "k", slices, spec, {"status": ["Active", "Closed"]}, folded=folded).toPandas().set_index("k")
    assert sorted(got.index) == [1, 2, 3]
    assert np.isnan(got.loc[1, "ACTIVE_AMT_SUM"]) and np.isnan(got.loc[3, "RECENT_AMT_SIZE"])  # no rows in the slice
    assert got.loc[2, "ACTIVE_AMT_SUM"] == 0 and np.isnan(got.loc[2, "ACTIVE_AMT_MEAN"])  # rows, but only nulls
    assert got.loc[1, "ALL_AMT_SUM"] == 5 and got.loc[1, "RECENT_AMT_SIZE"] == 1
    assert got.loc[1, "ALL_STATUS_CLOSED_MEAN"] == 1 and got.loc[1, "ALL_STATUS_NAN_MEAN"] == 0


def test_folded_slices_equal_those_of_copied_rows(spark):
    """Overlapping subsets, null conditions, rows in no subset, a hot key, decimals, NaN and nulls."""
    rng = np.random.default_rng(8)
    n = 5000
    frame = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.34, 7, rng.integers(0, 400, n)),
        "kind": rng.choice(["a", "b", "c"], n),
        "v": 10 + rng.normal(size=n),
        "w": rng.integers(-5, 5, n),
    })
    df = spark.createDataFrame(frame).withColumns({
        "k": F.when(F.col("k") != 3, F.col("k")),
        "kind": F.when(F.col("kind") != "c", F.col("kind")),
        "v": F.when(F.col("w") != 0, F.col("v")),
        "money": F.col("w").cast("decimal(9,2)") / 4,
        "odd": F.when(F.col("w") == 4, F.lit(float("nan"))).otherwise(F.col("w").cast("double")),
    })
    spec = {c: ["min", "max", "mean", "sum", "var", "std", "count"] for c in ("v", "w", "money", "odd")} | {"k": ["size"]}
    slices = {"A": F.col("kind") == "a", "B": F.col("kind") == "b", "POS": F.col("w") > 0, "TOP": F.col("w") > 2}
    vocab = {"kind": ["a", "b"]}
    names = A._stat_names(spec, vocab, True)
    want = A.slice_aggregate(df, "k", slices, [*A.build_aggs(spec), *A.share_aggs(vocab)], names)
    got = A.sliced_stats(df.repartition(5), "k", slices, spec, vocab, folded=True)
    assert got.dtypes == want.dtypes
    a, b = (x.toPandas().set_index("k").sort_index().astype(float) for x in (got, want))
    assert a.index.tolist() == b.index.tolist() and len(a) > 300
    pd.testing.assert_frame_equal(a, b, rtol=1e-12, atol=1e-12)
    plan = A.sliced_stats(df, "k", slices, spec, vocab, folded=True)._jdf.queryExecution().executedPlan().toString()
    rows_below = plan[plan.rindex("Generate") :]
    assert rows_below.count("Exchange") == 2 and plan[: plan.rindex("Generate")].count("Exchange") == 0
    assert A.sliced_stats(df.limit(0), "k", slices, spec, vocab, folded=True).collect() == []


def test_spread_of_values_far_from_zero(spark):
    """Sums of squares would lose every digit here; what stays is what a double near 1e9 can hold."""
    values = 1e9 + np.random.default_rng(2).normal(size=900)
    df = spark.createDataFrame([(1, float(v), i % 9) for i, v in enumerate(values)], "k int, v double, part int")
    slices = {"ALL": F.lit(True), **{f"P{i}": F.col("part") <= i for i in range(8)}}
    got = A.sliced_stats(df, "k", slices, {"v": ["var"]}, folded=True).first()
    centred = values - 1e9
    assert got["ALL_V_VAR"] == pytest.approx(centred.var(ddof=1), rel=1e-5)
    assert got["P3_V_VAR"] == pytest.approx(np.concatenate([centred[i::9] for i in range(4)]).var(ddof=1), rel=1e-5)


def test_distinct_counts_of_slices(credits):
    got = A.sliced_stats(credits, "k", {"ALL": F.lit(True), "OPEN": F.col("status") == "Active"}, {"days": ["nunique", "mean"]}, folded=True)
    assert {r["k"]: (r["ALL_DAYS_NUNIQUE"], r["OPEN_DAYS_NUNIQUE"]) for r in got.collect()} == {1: (2, None), 2: (2, 2), 3: (1, 1)}


def test_single_row_group_has_no_spread(credits):
    row = A.aggregate_by(credits, "k", {"amt": ["std", "var", "median", "mean"]}).where("k = 3").first()
    assert row["_AMT_STD".lstrip("_")] is None and row["AMT_VAR"] is None and row["AMT_MEDIAN"] == 7.0


def test_null_keys_are_dropped(credits):
    assert sorted(r["k"] for r in A.aggregate_all_numeric(credits, "k", "X_").collect()) == [1, 2, 3]


def test_null_group_gets_null_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "g STRING, v DOUBLE")
    got = {(r["g"], r["v"]): r["GRP_G_V_MEAN"] for r in A.with_group_stats(df, ["g"], {"v": ["mean", "median"]}).collect()}
    assert got == {("a", 1.0): 2.0, ("a", 3.0): 2.0, (None, 9.0): None}


def test_group_stats_with_a_hot_group_match_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": np.where(rng.random(4000) < 0.4, "hot", rng.integers(0, 30, 4000).astype(str)), "h": rng.integers(0, 3, 4000), "v": rng.normal(size=4000)})
    got = A.with_group_stats(spark.createDataFrame(frame), ["g", "h"], {"v": ["mean", "median", "std"]}).toPandas().sort_values("v").reset_index(drop=True)
    frame = frame.sort_values("v").reset_index(drop=True)
    for g in ("g", "h"):
        for stat in ("mean", "median", "std"):
            assert np.allclose(got[f"GRP_{g.upper()}_V_{stat.upper()}"], frame.groupby(g)["v"].transform(stat))


def test_hot_keys_are_dealt_out(spark):
    """A third of the rows has one key, some have none: no row is lost, and the hot key's rows are
    spread over several tasks."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 != 1, F.col("id"))
    rows = spark.range(0, 9000, 1, 8).select(key.alias("k"), F.col("id").alias("v"))
    totals = rows.groupBy("k").agg(F.sum("v").alias("t"))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = rows.join(totals, "k", "left")
        spread = J.spread_join(rows, totals, ["k"], limit=100)
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))

        def tasks(df):
            return settle(df.withColumn("p", F.spark_partition_id())).where("k = 0").select("p").distinct().count()

        assert tasks(spread) > 1 == tasks(plain)
        inner = J.spread_join(rows, totals.where("k % 2 = 0"), ["k"], "inner", limit=100)
        assert inner.count() == rows.where("k % 2 = 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_copies_of_one_row_are_dealt_out(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"), F.lit("copy").alias("v"))
    spread = J.spread_join(rows, spark.createDataFrame([(1, 7)], "k INT, t INT"), ["k"], limit=200)
    assert spread.where("t = 7").count() == 4000
    assert spread.select(F.spark_partition_id()).distinct().count() > 1


def test_several_tables_are_joined_with_one_salt(spark):
    rows = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    a = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    b = rows.where("k > 1000").groupBy("k").agg(F.max("id").alias("m"))
    want = rows.join(a, "k", "left").join(b, "k", "left")
    got = J.spread_joins(rows, [a, b], ["k"], limit=100)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_big_lookup_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(J, "LOOKUP_ROWS", 10)
    rows = spark.range(100).withColumnRenamed("id", "k")
    got = J.lookup_join(rows, rows.withColumn("v", F.col("k") * 2), ["k"])
    assert got.where("v = 2 * k").count() == 100


def test_last_rows_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(50)] + [(2, 1, 1.0)], "k INT, o INT, v DOUBLE")
    got = W.last_k(df, "k", [F.col("o").desc()], 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["o"]) for r in got.collect()) == [(1, 47), (1, 48), (1, 49), (2, 1)]


def test_last_value_skips_null_but_last_row_does_not(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None)], "k INT, o INT, v DOUBLE")
    assert W.last_non_null(df, "k", "v", F.col("o"), "x").first()["x"] == 5.0
    assert W.last_k(df, "k", [F.col("o").desc()], 1).first()["v"] is None


def test_trends_match_polyfit(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(v)) for k in range(4) for i, v in enumerate(rng.normal(size=[1, 2, 15, 40][k]))]
    df = spark.createDataFrame(rows, "k INT, o INT, v DOUBLE")
    got = W.trend_slopes(df, "k", [F.col("o").desc()], ["v"], [12, 24]).toPandas().set_index("k")
    for k in range(4):
        y = [r[2] for r in rows if r[0] == k]
        for p in (12, 24):
            tail = y[-p:]
            value = got.loc[k, f"V_TREND_{p}"]
            if len(tail) < 2:
                assert np.isnan(value)
            else:
                assert value == pytest.approx(np.polyfit(range(len(tail)), tail, 1)[0])


def test_class_balance_with_one_class(spark):
    df = spark.createDataFrame([(0,), (0,), (None,)], "y INT")
    row = A.class_balance(df, "y").first()
    assert (row["n"], row["pct"], row["imbalance_ratio"], row["scale_pos_weight"]) == (2, 100.0, 1.0, 2.0)


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a INT, b STRING")
    assert [(r["column_name"], r["n_null"]) for r in A.null_profile(df).collect()] == [("b", 2), ("a", 0)]
    assert A.duplicate_profile(df).first().asDict() == {"n_rows": 3, "n_distinct": 2, "n_duplicates": 1}
    assert A.type_profile(df) == {"int": 1, "string": 1}


def test_join_chain_shapes(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k INT")
    b = spark.createDataFrame([(1, "x"), (None, "n")], "k INT, b STRING")
    assert J.join_chain([], "k") is None
    assert J.join_chain([a], "k").count() == 3
    assert J.join_chain([a, b], "k").count() == 1  # null keys do not match
    assert J.join_chain([a, b], ["k"], "outer").count() == 4


# --- encoders --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def colours(spark):
    return spark.createDataFrame([(1, "red", "a"), (2, None, "b"), (3, "blue", "c"), (4, "red", None)], "id INT, colour STRING, kind STRING")


def test_factorize_and_label_encode(colours):
    assert [r["code"] for r in E.factorize(colours, "colour", "code").orderBy("id").collect()] == [1, -1, 0, 1]
    assert [r["colour"] for r in E.label_encode(colours, ["colour"]).orderBy("id").collect()] == [2, 1, 0, 2]


def test_unseen_category_is_minus_one(spark, colours):
    codes = E.fit_codes(colours, "colour", E.MISSING)
    fresh = spark.createDataFrame([(1, "green"), (2, None), (3, "red")], "id INT, colour STRING")
    assert [r["c"] for r in E.apply_codes(fresh, codes, "colour", "c", E.MISSING).orderBy("id").collect()] == [-1, 0, 2]


def test_onehot_switches_to_codes_above_the_limit(colours):
    fitted = E.fit_onehot(colours, ["colour", "kind"], limit=2)
    got = fitted.apply(colours).orderBy("id").toPandas()
    assert fitted.new_columns() == ["colour_blue", "colour_red", "colour_nan"]
    assert got["colour_nan"].tolist() == [0, 1, 0, 0] and got["kind"].tolist() == [0, 1, 2, -1]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c STRING")
    assert E.fit_modes(df, ["c"]) == {"c": "a"}


@pytest.mark.parametrize("strategy,number,text", [("auto", 2.0, "a"), ("mean", 4.0, None), ("median", 2.0, None), ("mode", 1.0, "a"), ("drop", None, None)])
def test_impute_strategies(spark, strategy, number, text):
    df = spark.createDataFrame([(1.0, "a", None), (2.0, "a", None), (9.0, "b", 1.0), (None, None, None)], "n DOUBLE, t STRING, rare DOUBLE")
    filled = E.fit_imputer(df, strategy).apply(df)
    assert filled.columns == ["n", "t"]
    row = [r for r in filled.collect() if (r["n"], r["t"]) not in {(1.0, "a"), (2.0, "a"), (9.0, "b")}]
    want = (number, text)
    assert [tuple(r) for r in row] == ([want] if want not in {(1.0, "a"), (2.0, "a"), (9.0, "b")} else [])


def test_scaler_uses_population_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in E.fit_scaler(df).apply(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_vocabularies_keep_every_category(spark):
    rows = spark.range(2000).select((F.col("id") % 30).cast("string").alias("kind"), F.col("id").cast("string").alias("name"))
    assert len(A.vocabularies(rows, ["kind"])["kind"]) == 30
    assert A.vocabularies(rows, ["kind", "name"], limit=40).keys() == {"kind"}
    with pytest.raises(ValueError, match="name"):
        A.vocabularies(rows, ["kind", "name"])


def _odd_rows(spark):
    rng = np.random.default_rng(12)
    n = 3000
    frame = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.3, 5, rng.integers(0, 200, n)),
        "kind": rng.choice(["a", "b", "c"], n),
        "w": rng.integers(-3, 4, n),
    })
    return spark.createDataFrame(frame).withColumns({
        "k": F.when(F.col("k") != 3, F.col("k")),
        "kind": F.when(F.col("kind") != "c", F.col("kind")),
        "v": F.when(F.col("w") != 0, F.when(F.col("w") == 1, F.lit(-0.0)).when(F.col("w") == 2, F.lit(0.0)).otherwise(F.col("w") / 7)),
    })


@pytest.mark.parametrize("limit", [10**6, 100])
def test_slices_of_gathered_rows_equal_those_of_copies(spark, limit):
    """With and without keys above the limit; distinct counts, null conditions, keys in no subset."""
    df = _odd_rows(spark)
    spec = {"v": ["min", "max", "mean", "sum", "var", "std", "count", "nunique"], "w": ["sum", "mean", "nunique"], "k": ["size"]}
    slices = {"A": F.col("kind") == "a", "TOP": F.col("w") > 2}
    vocab = {"kind": ["a", "b"]}
    want = A.slice_aggregate(df, "k", slices, [*A.build_aggs(spec), *A.share_aggs(vocab)], A._stat_names(spec, vocab, True))
    got = A.sliced_stats(df.repartition(5), "k", slices, spec, vocab, limit=limit)
    assert got.dtypes == want.dtypes
    a, b = (x.toPandas().set_index("k").sort_index().astype(float) for x in (got, want))
    assert a.index.tolist() == b.index.tolist() and len(a) > 150
    pd.testing.assert_frame_equal(a, b, rtol=1e-12, atol=1e-12)


def test_slices_shuffle_rows_and_no_aggregates(spark):
    """One exchange, below the only aggregate, which goes through sorted rows."""
    df = _odd_rows(spark)
    plan = A.sliced_stats(df, "k", {"A": F.col("kind") == "a"}, {"v": ["mean", "var"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Aggregate") == 1 == plan.count("SortAggregate")


def test_hot_keys_are_found_by_bucket_and_by_key(spark):
    rows = _odd_rows(spark)
    want = {r["k"]: -(-r["count"] // 15) for r in rows.groupBy("k").count().where("count > 15").collect()}
    assert {r["k"]: r["__parts"] for r in J.hot_keys(rows, ["k"], 15).collect()} == want and len(want) > 1


@pytest.mark.parametrize("limit", [10**6, 40])
def test_group_totals_of_missing_and_hot_keys(spark, limit):
    df = _odd_rows(spark)
    got = A.with_group_total(df, ["k", "kind"], "w", "t", limit)
    totals = {(r["k"], r["kind"]): r["t"] for r in df.groupBy("k", "kind").agg(F.sum("w").alias("t")).collect()}
    rows = got.collect()
    assert got.columns == [*df.columns, "t"] and len(rows) == df.count()
    assert all(r["t"] == (None if r["k"] is None or r["kind"] is None else totals[r["k"], r["kind"]]) for r in rows)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_wide_slices_are_folded_a_column_at_a_time(spark, monkeypatch, batch):
    """Over odd rows, with keys that lie in several batches; the same as one aggregate per statistic."""
    rows = []
    for i in range(240):
        odd = {0: None, 1: float("nan"), 2: float("inf"), 3: -0.0}.get(i % 29)
        rows.append((None if i % 31 == 0 else i % 7 if i < 200 else i, "abcd"[i % 4] if i % 5 else None, float(i * 37 % 101) if i % 29 > 3 else odd, None if i % 3 == 0 or i % 7 == 2 else i - 100, i * 2**40))
    df = spark.createDataFrame(rows, "k LONG, kind STRING, v DOUBLE, n INT, big LONG")
    slices = {"ALL": F.lit(True), "A": F.col("kind") == "a", "LATE": F.col("n") > 60, "NONE": F.col("kind") == "z"}
    spec = {"v": ["min", "max", "mean", "sum", "var", "count", "size"], "n": ["min", "max", "mean", "sum", "var"], "big": ["sum", "max", "min"]}
    vocab = {"kind": ["a", "b"]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = {}
        for wide in (0, 10_000):
            monkeypatch.setattr(A, "WIDE", wide)
            got = A.sliced_stats(df, "k", slices, spec, vocab)
            assert ("MapInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (wide == 0)
            found[wide] = got.schema.simpleString(), {r["k"]: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (names, mine), (other_names, plain) = found[0], found[10_000]
    assert names == other_names and mine.keys() == plain.keys() and len(mine) > 40
    for k, row in plain.items():
        assert [v is None for v in mine[k]] == [v is None for v in row], k
        assert [v for v in mine[k] if v is not None] == pytest.approx([v for v in row if v is not None], rel=1e-9, abs=1e-9, nan_ok=True), k


def test_whole_numbers_that_sum_too_high_are_an_error():
    value, starts = np.array([2**62, 2**62, 5]), np.array([0, 2])
    with pytest.raises(OverflowError):
        A._folded(value, np.ones(3, bool), "sum", starts, np.array([2, 1]), np.array([2, 1]))
    assert A._folded(value[1:], np.ones(2, bool), "sum", np.array([0]), np.array([2]), np.array([2]))[0].tolist() == [2**62 + 5]
