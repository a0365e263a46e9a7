"""Fits on wide tables: medians of many columns against brute force, and what it costs to describe them."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tallyrisk.operators import clean as C, running as R, selection as S
from tallyrisk.plans import fitted as L


@pytest.fixture(scope="module")
def values():
    """Even and odd numbers of values, ties, few values, infinite ones, both zeros, and a column of none."""
    rng = np.random.default_rng(5)
    x = rng.lognormal(3, 4, (3001, 70))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 1] = np.round(rng.exponential(2, len(x)))
    x[:, 2] = rng.choice([-0.0, 0.0, 1.0], len(x))
    x[:, 3] = np.nan
    x[:, 4] = np.where(rng.random(len(x)) < 0.9, 7.0, x[:, 4])
    x[rng.random(len(x)) < 0.01, 5] = np.inf
    x[1:, 6] = np.nan
    return x


@pytest.fixture(scope="module")
def table(spark, values):
    # Rows in order, so that no part of the table is like the whole; NaN and null are both no values.
    order = np.argsort(values[:, 0])
    rows = [(i, [None if np.isnan(v) and i % 2 else float(v) for v in values[j]]) for i, j in enumerate(order)]
    df = spark.createDataFrame(rows, "id INT, v ARRAY<DOUBLE>").repartitionByRange(5, "id")
    return df.select(*[F.expr(f"v[{j}] AS `c.{j}`") for j in range(values.shape[1])])


@pytest.mark.parametrize(("open_cells", "margin", "in_one_task"), [(S.OPEN_CELLS, S.MANY_MARGIN, S.IN_ONE_TASK), (0, S.MANY_MARGIN, S.IN_ONE_TASK), (0, 0.0, S.IN_ONE_TASK), (0, 0.3, 100)])
def test_medians_of_many_against_numpy(table, values, open_cells, margin, in_one_task, monkeypatch):
    """Open bounds, bounds that hold, bounds that miss, and more values than a task may order."""
    monkeypatch.setattr(S, "STEP_CELLS", 70 * 200)
    got = {r["feature"]: r["median"] for r in S.medians_of_many(table, table.columns, open_cells, margin, in_one_task).collect()}
    want = {f"c.{j}": float(np.median(own)) for j in range(values.shape[1]) if len(own := values[:, j][~np.isnan(values[:, j])])}
    assert got == pytest.approx(want, rel=1e-15) and "c.3" not in got


def test_tables_without_values(table):
    assert S.medians_of_many(table.limit(0), table.columns).collect() == []
    assert S.medians_of_many(table.select(F.col("`c.3`").alias("a")), ["a"]).collect() == []


def _calls(spark, run):
    """How often the JVM is called."""
    client, n = spark._jvm._gateway_client, [0]
    send = client.send_command

    def counted(*args, **kwargs):
        n[0] += 1
        return send(*args, **kwargs)

    client.send_command = counted
    try:
        run()
    finally:
        del client.send_command
    return n[0]


def test_wide_tables_are_described_in_few_calls(spark):
    """A call to the JVM per column at most, some for the table: a model of a thousand columns is fitted and applied in seconds."""
    width = 300
    df = spark.range(40).select("id", *[F.expr(f"CAST(id * {j} % 17 AS DOUBLE) AS n{j}") for j in range(width)])
    names = [f"n{j}" for j in range(width)]
    medians = {}
    assert _calls(spark, lambda: medians.update(R.fit_medians(df, names))) < 4 * width
    assert _calls(spark, lambda: C.align(df, names, medians, ["id"])) < 6 * width
    assert medians["n1"] == float(np.median(np.arange(40) % 17)) and len(medians) == width


def test_aligned_values(spark):
    df = spark.createDataFrame([(1, None, "2.5", None), (2, 3, "x", 1.0)], "id INT, a INT, b STRING, `c.d` DOUBLE")
    rows = C.align(df, ["a", "b", "c.d", "gone"], {"a": 1e-7, "b": -1e300, "c.d": float("inf"), "gone": 4.0}, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1e-7, 2.5, float("inf"), 4.0), (2, 3.0, -1e300, 1.0, 4.0)]


def test_small_tables_are_looked_up_like_joins(spark, monkeypatch):
    """Odd texts, a null, an unknown value and statistics that are null or have many digits; the same from joins when there are many."""
    odd = ["a'b", 'q"\\', "", "é\n", None, "once"]
    rows = [(i, i % 2, odd[i % 5] if i else "once", 1e9 / (i + 3)) for i in range(40)]
    train = spark.createDataFrame(rows, "SK_ID_CURR INT, TARGET INT, CODE_GENDER STRING, AMT_INCOME_TOTAL DOUBLE")
    others = train.unionByName(spark.createDataFrame([(99, None, "new", 1.0)], train.schema))
    model = L.ApplicantEncoder(groups=["CODE_GENDER"]).fit(train)
    literal = model.transform(others)
    monkeypatch.setattr(L, "MAX_CATEGORIES", 1)
    joined = model.transform(others)
    assert literal.columns == joined.columns and literal.dtypes == joined.dtypes
    assert sorted(literal.collect()) == sorted(joined.collect())
    assert {r["CODE_GENDER"]: r["CODE_GENDER_CODE"] for r in literal.collect()} == {"": 0, None: 1, "a'b": 2, "once": 3, 'q"\\': 4, "é\n": 5, "new": -1}
    assert literal._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_folds_side_by_side_give_the_same_scores(spark, tmp_path):
    rows = spark.range(90).selectExpr("CAST(id AS INT) SK_ID_CURR", "IF(id < 80, CAST(id % 2 AS INT), NULL) TARGET", "IF(id % 3 = 0, 'x', 'y') KIND", "CAST(id * 7 % 31 AS DOUBLE) N")
    forest = RandomForestClassifier(featuresCol=L.FEATURES, labelCol="TARGET", weightCol=L.WEIGHT, numTrees=3, seed=42)
    found = [sorted(map(tuple, L.train_on_applicants(forest, rows, "SK_ID_CURR", 3, str(tmp_path / f"p{n}"), parallelism=n).collect()), key=str) for n in (1, 3)]
    assert found[0] == found[1] and len(found[0]) == 90


def test_a_fold_that_fails_is_reported(spark, tmp_path):
    rows = spark.range(20).selectExpr("CAST(id AS INT) SK_ID_CURR", "CAST(id % 2 AS INT) TARGET", "CAST(id AS DOUBLE) N")
    forest = RandomForestClassifier(featuresCol="nowhere", labelCol="TARGET")
    with pytest.raises(Exception, match="nowhere"):
        L.train_on_applicants(forest, rows, "SK_ID_CURR", 2, str(tmp_path / "failed"))
