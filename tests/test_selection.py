"""Selected quantiles against brute force, with bounds that hold, that are open and that miss."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import running as R, selection as S

QUANTILES = {"none": 0.0, "low": 0.03, "half": 0.5, "high": 0.95, "all": 1.0}


@pytest.fixture(scope="module")
def frame():
    """A third of the rows in one group, ties, nulls, NaN, infinite values, a column of few values and one of none."""
    rng = np.random.default_rng(11)
    n = 12_000
    frame = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 9, n).astype(str)),
        "wide": rng.normal(0, 1, n),
        "ties": np.round(rng.exponential(2, n), 0),
        "two": np.where(rng.random(n) < 0.5, -1.0, 3.0),
    })
    frame.loc[rng.random(n) < 0.05, "wide"] = np.nan
    frame.loc[rng.random(n) < 0.01, "ties"] = np.inf
    frame.loc[rng.random(n) < 0.02, "g"] = None
    return frame


@pytest.fixture(scope="module")
def table(spark, frame):
    # NaN and null are both no values.
    df = spark.createDataFrame(frame.astype({"g": object}).where(frame.notna(), None), "g string, wide double, ties double, two double")
    df = df.withColumns({"wide": F.when(F.col("wide") > 2.5, F.lit(float("nan"))).otherwise(F.col("wide")), "empty": F.lit(None).cast("double")})
    return df.repartition(5)


def wanted(frame, column, interpolation):
    values = frame[column].dropna()
    values = np.sort(values[values <= 2.5] if column == "wide" else values)
    return [float(np.quantile(values, p, method=interpolation)) for p in QUANTILES.values()]


@pytest.mark.parametrize("in_one_task", [100, 1500, S.IN_ONE_TASK])
@pytest.mark.parametrize("method", ["linear", "lower"])
def test_against_numpy(table, frame, in_one_task, method):
    columns = ["wide", "ties", "two", "empty"]
    whole = S.selected_quantiles(table, columns, QUANTILES, method=method, in_one_task=in_one_task).collect()
    assert sorted(r["feature"] for r in whole) == ["ties", "two", "wide"]
    for r in whole:
        got, want = [r[q] for q in QUANTILES], wanted(frame, r["feature"], method)
        if r["feature"] == "ties" and method == "linear":
            got, want = got[:-1], want[:-1]  # the last lies between two infinite values
        assert got == pytest.approx(want, abs=1e-12)
    grouped = S.selected_quantiles(table, columns, QUANTILES, ["g"], method, in_one_task).collect()
    assert len(grouped) == 3 * frame["g"].nunique()
    for r in grouped:
        if r["feature"] != "ties":
            assert [r[q] for q in QUANTILES] == pytest.approx(wanted(frame[frame.g == r["g"]], r["feature"], method), abs=1e-12)


def test_bounds_that_miss_are_opened(table, frame, monkeypatch):
    """A sketch that is far too coarse for its margin costs time, not rightness."""
    monkeypatch.setattr(S, "SKETCH", 8)
    monkeypatch.setattr(S, "MARGIN", 0.0005)
    got = S.selected_quantiles(table, ["wide", "two"], QUANTILES, in_one_task=100).collect()
    for r in got:
        assert [r[q] for q in QUANTILES] == pytest.approx(wanted(frame, r["feature"], "linear"), abs=1e-12)


def test_few_values_are_ordered(spark, monkeypatch):
    """What reaches the last shuffle is the part between the bounds."""
    seen = []

    def watch(df, order, sums, groups=()):
        seen.append(df.count())
        return R.running_totals(df, order, sums, groups)

    monkeypatch.setattr(S, "running_totals", watch)
    df = spark.range(400_000).select(F.rand(5).alias("v"))
    got = S.selected_quantiles(df, ["v"], {"m": 0.5}, in_one_task=1000).first()["m"]
    assert got == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert seen and seen[0] < 400_000 * 4 * S.MARGIN


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert S.selected_quantiles(df, ["v"], QUANTILES).collect() == []
    assert S.selected_quantiles(df, ["v"], QUANTILES, ["g"]).collect() == []
    assert R.exact_quantiles(df, "v", {"p": 0.5}).first()["p"] is None


def test_repeated_rows_and_decimal_columns(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (8,), (None,)], "v int").withColumn("d", F.col("v").cast("decimal(9,2)"))
    got = {r["feature"]: (r["a"], r["b"]) for r in S.selected_quantiles(df, ["v", "d"], {"a": 0.5, "b": 0.9}).collect()}
    assert got == {"v": (1.0, pytest.approx(5.9)), "d": (1.0, pytest.approx(5.9))}
