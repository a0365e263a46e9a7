"""Running totals and quantiles against brute force, over several chunks and with hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import running as R


@pytest.fixture(scope="module")
def hot():
    """A third of all rows in one group, many equal values, nulls and NaN."""
    rng = np.random.default_rng(3)
    n = 6000
    frame = pd.DataFrame({"g": np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str)), "v": np.round(rng.exponential(10, n), 1)})
    frame.loc[rng.random(n) < 0.05, "v"] = np.nan
    return frame


def test_running_totals_over_many_chunks(spark):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = R.running_totals(df, ["v"], ["n"], next_of="v").orderBy("v").toPandas()
    base = np.arange(n) % 7
    assert (got["n_before"].to_numpy() == np.concatenate([[0], np.cumsum(base)[:-1]])).all()
    assert (got["n_total"] == base.sum()).all()
    assert got["v_next"].iloc[:-1].tolist() == list(range(1, n)) and np.isnan(got["v_next"].iloc[-1])


def test_chunks_are_really_several(spark):
    placed = R.in_chunks(spark.range(4000).withColumnRenamed("id", "v"), ["v"])
    assert placed.select("__chunk").distinct().count() > 1


def test_grouped_quantiles_match_numpy(spark, hot):
    df = spark.createDataFrame(hot)
    got = R.exact_quantiles(df, "v", {"a": 0.5, "b": 0.95}, ["g"]).toPandas().set_index("g").sort_index()
    want = hot.groupby("g")["v"].quantile([0.5, 0.95]).unstack().sort_index()
    assert np.allclose(got["a"], want[0.5]) and np.allclose(got["b"], want[0.95])


def test_lower_rank_quantile(spark, hot):
    values = sorted(hot["v"].dropna())
    got = R.exact_quantiles(spark.createDataFrame(hot), "v", {"a": 0.5, "b": 0.95}, method="lower").first()
    assert got["a"] == values[int(0.5 * (len(values) - 1))] and got["b"] == values[int(0.95 * (len(values) - 1))]


def test_three_kinds_of_p95_differ(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v DOUBLE")
    assert R.exact_quantiles(df, "v", {"p": 0.95}).first()["p"] == pytest.approx(8.95)
    assert R.exact_quantiles(df, "v", {"p": 0.95}, method="lower").first()["p"] == 3.0


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v DOUBLE")
    assert R.exact_quantiles(df, "v", {"p": 0.5}).first()["p"] is None


def test_fit_medians(spark, hot):
    df = spark.createDataFrame(hot).withColumns({"w": F.col("v") * 2, "empty": F.lit(None).cast("double")})
    got = R.fit_medians(df, ["v", "w", "empty"])
    assert got == {"v": pytest.approx(hot["v"].median()), "w": pytest.approx(2 * hot["v"].median())}


def test_positions(spark):
    df = spark.createDataFrame([("a", i) for i in range(900)] + [("b", 5), ("b", 2)], "g STRING, k INT")
    got = R.ranked(df, ["k"], ["g"]).toPandas()
    a = got[got.g == "a"].sort_values("k")
    assert a["position"].tolist() == list(range(900)) and set(a["group_size"]) == {900}
    assert got[got.g == "b"].set_index("k")["position"].to_dict() == {2: 0, 5: 1}
