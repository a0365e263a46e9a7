"""Rows for a fit: no partition is larger than the limit, and rows that fit already stay where they are."""

from tallyrisk.session import settle_evenly


def test_large_partitions_are_dealt_out(spark):
    rows = spark.range(0, 1000, 1, 2)
    got = settle_evenly(rows, 100)
    sizes = got.rdd.glom().map(len).collect()
    assert max(sizes) <= 120 and len(sizes) == 10
    assert sorted(r["id"] for r in got.collect()) == list(range(1000))


def test_small_partitions_stay(spark):
    assert settle_evenly(spark.range(0, 1000, 1, 2), 500).rdd.getNumPartitions() == 2
    assert settle_evenly(spark.range(0), 500).count() == 0
