"""The reference of drift: rows kept as CSV pairs, the wide CSV made of them, and its comparison with the logs."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyrisk.operators import drift as D
from tallyrisk.plans import monitoring_run as MR
from tallyrisk.sources import tables as T


def brute_features(columns, row, names, medians):
    cells = dict(zip(next(csv.reader(io.StringIO(columns)), []), next(csv.reader(io.StringIO(row)), [])))

    def number(name):
        try:
            return float(cells[name])
        except (KeyError, ValueError):
            return medians.get(name, 0.0)

    return [number(n) for n in names]


def test_pairs_against_the_csv_module(spark):
    """Quoted cells, repeated names, missing cells, names beyond the row, text where a number should be."""
    rng = random.Random(3)
    names, medians = ["a", "b", "long name", 'q"uote', "absent"], {"a": 1.5, "b": -2.0, 'q"uote': 9.0}
    heads = ["a", "b", "long name", '"q""uote"', '"x, y"', "other", "a"]
    values = ["1", "-2.5", "", "text", '"3, 4"', '"7"', "1e3", '"say ""no"""']
    rows = []
    for _ in range(200):
        n = rng.randint(1, 9)
        rows.append((",".join(rng.choice(heads) for _ in range(n)), ",".join(rng.choice(values) for _ in range(rng.randint(1, 9)))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, columns_csv string, row_csv string")
    got = {r["id"]: list(r)[1:] for r in T.csv_pair_features(df, names, medians).collect()}
    for i, (columns, row) in enumerate(rows):
        assert got[i] == brute_features(columns, row, names, medians), (columns, row)


def test_wide_rows(spark):
    names = [f"f{i}" for i in range(600)]
    df = spark.createDataFrame([(",".join(names), ",".join(map(str, range(600))))] * 20, "columns_csv string, row_csv string")
    rows = T.csv_pair_features(df, names, {}).collect()
    assert len(rows) == 20 and list(rows[7]) == [float(i) for i in range(600)]


def test_null_pairs_take_the_medians(spark):
    df = spark.createDataFrame([(None, None), ("a", None), (None, "1"), ("", "")], "columns_csv string, row_csv string")
    assert [tuple(r) for r in T.csv_pair_features(df, ["a"], {"a": 4.0}).collect()] == [(4.0,)] * 4


def test_the_reference_is_made_once(spark, tmp_path):
    path = str(tmp_path / "reference")
    first = spark.createDataFrame([("a,b", "1,x"), ("a,b", "2,5")], "columns_csv string, row_csv string")
    other = spark.createDataFrame([("a,b", "8,8")], "columns_csv string, row_csv string")
    want = [(1.0, 0.5), (2.0, 5.0)]
    assert sorted(map(tuple, T.ensure_reference(first, path, ["a", "b"], {"b": 0.5}).collect())) == want
    assert sorted(map(tuple, T.ensure_reference(other, path, ["a", "b"], {}).collect())) == want


@pytest.mark.parametrize("wide", [True, False])
def test_counts_in_one_pass_equal_those_of_two(spark, wide):
    reference = spark.createDataFrame([(1.0, None, 5.0), (2.0, 3.0, 5.0), (2.0, 4.0, None), (None, 4.0, 1.0)], "a double, b double, only double")
    logs = spark.createDataFrame([({"a": 2.0, "b": None},), ({"a": 7.0},), ({},), (None,), ({"b": float("nan"), "new": 1.0},)], "input_features map<string,double>")
    maps = MR.feature_maps(reference)
    got = sorted(map(tuple, MR.reference_counts(reference if wide else maps, logs).collect()))
    cells = lambda df: df.select(F.explode("input_features").alias("feature", "value")).where("value IS NOT NULL AND NOT isnan(value)")
    want = D.side_counts(cells(maps), cells(logs), 4, 3)
    assert got == sorted(map(tuple, want.collect())) and {r[0] for r in got} == {"a"}


def test_a_run_falls_back_on_a_wide_reference(spark):
    logs = spark.createDataFrame([(i, 200, 5.0, "OK", {"k": float(i), "x": 1.0}) for i in range(10)], "id long, status_code int, latency_ms double, decision string, input_features map<string,double>")
    reference = spark.createDataFrame([(float(i + 50), "text") for i in range(40)], "k double, note string")
    counts = MR.reference_counts(reference, logs)
    verdict = D.drift_verdict(D.drift_tests(counts)).first()
    assert (verdict["enabled"], verdict["n_features_compared"], verdict["n_drifted"]) == (True, 1, 1)
    assert MR.reference_counts(reference.limit(0), logs).count() == 0
