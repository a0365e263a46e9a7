"""Feature drift between a reference and a current table, both in long form (feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyrisk.operators.joins import lookup_join
from tallyrisk.operators.running import quantiles_of_counts, running_totals
from tallyrisk.session import settle

# Significance limit of the drift test, and the width below which the series of
# the limiting distribution is 1 to double precision.
DRIFT_LEVEL = 0.05
_FLAT = 0.2


def side_counts(reference: DataFrame, current: DataFrame, n_reference: Column | int, n_current: Column | int) -> DataFrame:
    """Rows per (feature, value) and side. Both inputs are long (feature, value) rows without
    nulls; ``n_*`` are the row numbers of the sides, so that absent cells can be counted.
    Absent cells take the reference median on both sides. Only features met on both sides stay."""
    marked = reference.select("feature", "value", F.lit(1).cast("long").alias("r"), F.lit(0).cast("long").alias("c")).unionByName(
        current.select("feature", "value", F.lit(0).cast("long").alias("r"), F.lit(1).cast("long").alias("c"))
    )
    as_long = [F.lit(n).cast("long") if isinstance(n, int) else n.cast("long") for n in (n_reference, n_current)]
    return _absent_filled(_counted(marked), *as_long)


def map_counts(reference: DataFrame, current: DataFrame, features: str = "input_features") -> DataFrame:
    """``side_counts`` of two tables of feature maps in one pass over each: a row adds one cell without a name besides its
    own cells, so the row numbers of the sides come out of the same counts. Rows without any feature do not count."""
    nameless = F.struct(F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("value"))

    def cells(df: DataFrame, is_reference: int) -> DataFrame:
        filled = df.where(F.size(F.coalesce(F.col(features), F.create_map().cast("map<string,double>"))) > 0)
        long = filled.select(F.inline(F.concat(F.array(nameless), F.map_entries(features))).alias("feature", "value"))
        sides = {"r": F.lit(is_reference).cast("long"), "c": F.lit(1 - is_reference).cast("long")}
        return long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumns(sides)

    counts = _counted(cells(reference, 1).unionByName(cells(current, 0)))
    rows = counts.where("feature IS NULL").agg(F.coalesce(F.sum("n_ref"), F.lit(0)).alias("n_ref"), F.coalesce(F.sum("n_cur"), F.lit(0)).alias("n_cur"))
    return _absent_filled(counts.where("feature IS NOT NULL"), rows.select("n_ref").scalar(), rows.select("n_cur").scalar())


def _counted(marked: DataFrame) -> DataFrame:
    """The raw rows are read once; everything else works on the counts per distinct value."""
    return settle(marked.groupBy("feature", "value").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur")))


def _absent_filled(counts: DataFrame, n_reference: Column, n_current: Column) -> DataFrame:
    sizes = counts.groupBy("feature").agg(F.sum("n_ref").alias("s_ref"), F.sum("n_cur").alias("s_cur"))
    common = sizes.where("s_ref > 0 AND s_cur > 0")
    of_reference = counts.where("n_ref > 0").select("feature", "value", F.col("n_ref").alias("n"))
    medians = quantiles_of_counts(of_reference, {"value": 0.5}, ["feature"])
    absent = medians.join(common, "feature").select(
        "feature", "value", (n_reference - F.col("s_ref")).alias("n_ref"), (n_current - F.col("s_cur")).alias("n_cur")
    )
    present = lookup_join(counts, common.select("feature"), ["feature"], "left_semi")
    both = present.unionByName(absent.where("n_ref > 0 OR n_cur > 0"))
    return both.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def feature_validity(counts: DataFrame) -> DataFrame:
    """Row and distinct numbers per feature and side; valid with at least 2 rows and 2 values on both."""
    found = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("n_ref"),
        F.sum("n_cur").alias("n_cur"),
        F.count_if(F.col("n_ref") > 0).alias("distinct_ref"),
        F.count_if(F.col("n_cur") > 0).alias("distinct_cur"),
    )
    enough = (F.least("n_ref", "n_cur") >= 2) & (F.least("distinct_ref", "distinct_cur") > 1)
    return found.withColumn("is_valid", enough)


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic, with the
    small-sample correction of Stephens (1970)."""
    root = F.sqrt(F.try_divide(n * m, n + m))
    lam = (root + F.lit(0.12) + F.try_divide(F.lit(0.11), root)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    return F.when(lam < _FLAT, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * series)))


def drift_tests(counts: DataFrame, level: float = DRIFT_LEVEL) -> DataFrame:
    """Per valid feature: KS statistic, p-value, drift flag, 1-Wasserstein distance and mean shift,
    both divided by the reference standard deviation."""
    counts = settle(counts)  # used four times below
    valid = feature_validity(counts).where("is_valid").select("feature")
    rows = lookup_join(counts, valid, ["feature"], "left_semi")
    run = running_totals(rows, ["value"], ["n_ref", "n_cur"], ["feature"], next_of="value")
    f_ref = (F.col("n_ref_before") + F.col("n_ref")) / F.col("n_ref_total")
    f_cur = (F.col("n_cur_before") + F.col("n_cur")) / F.col("n_cur_total")
    gap = F.coalesce(F.col("value_next") - F.col("value"), F.lit(0.0))
    # Second moments around the feature mean would need another pass; the table of distinct values
    # is small against the raw rows, so the mean is joined first.
    means = rows.groupBy("feature").agg(
        (F.sum(F.col("value") * F.col("n_ref")) / F.sum("n_ref")).alias("mean_ref"),
        (F.sum(F.col("value") * F.col("n_cur")) / F.sum("n_cur")).alias("mean_cur"),
    )
    away = F.col("value") - F.col("mean_ref")
    found = lookup_join(run, means, ["feature"], "inner").groupBy("feature").agg(
        F.max("n_ref_total").cast("double").alias("n"),
        F.max("n_cur_total").cast("double").alias("m"),
        F.max("mean_ref").alias("mean_ref"),
        F.max("mean_cur").alias("mean_cur"),
        F.sum(F.col("n_ref") * away * away).alias("__ss"),
        F.max(F.abs(f_ref - f_cur)).alias("ks"),
        F.sum(F.abs(f_ref - f_cur) * gap).alias("__w"),
    )
    spread = F.sqrt(F.try_divide(F.col("__ss"), F.col("n") - 1))
    p = ks_p_value(F.col("ks"), F.col("n"), F.col("m"))
    return found.select(
        "feature",
        F.col("n").cast("long").alias("n_reference"),
        F.col("m").cast("long").alias("n_current"),
        "ks",
        p.alias("p_value"),
        (p < F.lit(level)).alias("drifted"),
        F.try_divide("__w", spread).alias("wasserstein"),
        F.try_divide(F.col("mean_cur") - F.col("mean_ref"), spread).alias("mean_shift"),
    )


def drift_verdict(tests: DataFrame) -> DataFrame:
    """Number of features compared, number and share drifted; enabled with at least one feature."""
    n = F.count(F.lit(1))
    hit = F.count_if("drifted")
    return tests.agg(
        (n > 0).alias("enabled"),
        n.alias("n_features_compared"),
        hit.alias("n_drifted"),
        F.coalesce(F.try_divide(hit, n), F.lit(0.0)).alias("share_drifted"),
    )
