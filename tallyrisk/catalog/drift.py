"""Feature drift on order and line values before and after a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrisk.catalog.base import query, table
from tallyrisk.operators import drift as D
from tallyrisk.plans.monitoring_run import reference_counts
from tallyrisk.session import scratch_path
from tallyrisk.sources.tables import ensure_reference

# Long form (side, feature, value); tax is null for a part of the lines, one feature is constant on
# one side and one exists on one side only.
_CUT = "1998-06-01"
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]
_CELLS_SQL = f"""lines AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '{_CUT}' THEN 'ref' ELSE 'cur' END AS side, l_quantity, l_extendedprice, l_discount + CASE WHEN l_shipdate < TIMESTAMP '{_CUT}' THEN 0 ELSE 0.01 END AS l_discount,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_shipdate < TIMESTAMP '{_CUT}' THEN 1.0 ELSE l_quantity END AS constant FROM lineitem),
    med AS (SELECT quantile_cont(l_tax, 0.5) AS m FROM lines WHERE side = 'ref'),
    cells AS ({" UNION ALL ".join(f"SELECT side, '{c}' AS feature, CAST({'coalesce(l_tax, m)' if c == 'l_tax' else c} AS DOUBLE) AS v FROM lines, med" for c in _FEATURES)})"""


def _counts(spark, sf):
    before = F.col("l_shipdate") < F.to_timestamp_ntz(F.lit(f"{_CUT} 00:00:00"))
    lines = table(spark, sf, "lineitem").select(
        before.alias("is_ref"),
        "l_quantity",
        "l_extendedprice",
        (F.col("l_discount") + F.when(before, 0.0).otherwise(0.01)).alias("l_discount"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("l_tax"),
        F.when(before, 1.0).otherwise(F.col("l_quantity")).alias("constant"),
    )
    from tallyrisk.operators.running import long_form

    sides = [lines.where("is_ref"), lines.where("NOT is_ref")]
    long = [long_form(s, [*_FEATURES]) for s in sides]
    sizes = [s.agg(F.count(F.lit(1))).scalar() for s in sides]
    only_now = long[1].where("feature = 'l_quantity'").withColumn("feature", F.lit("new_feature"))
    return D.side_counts(long[0], long[1].unionByName(only_now), *sizes)


@query(
    "drift_valid_features",
    f"""WITH {_CELLS_SQL}, s AS (SELECT feature, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'cur') AS n_cur,
    count(DISTINCT CASE WHEN side = 'ref' THEN v END) AS distinct_ref, count(DISTINCT CASE WHEN side = 'cur' THEN v END) AS distinct_cur FROM cells GROUP BY 1)
    SELECT *, least(n_ref, n_cur) >= 2 AND least(distinct_ref, distinct_cur) > 1 AS is_valid FROM s""",
)
def drift_valid_features(spark, sf):
    return D.feature_validity(_counts(spark, sf))


_TESTS = f"""WITH {_CELLS_SQL}, valid AS (SELECT feature FROM cells GROUP BY 1 HAVING count(DISTINCT CASE WHEN side = 'ref' THEN v END) > 1 AND count(DISTINCT CASE WHEN side = 'cur' THEN v END) > 1),
    g AS (SELECT feature, v, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c FROM cells JOIN valid USING (feature) GROUP BY 1, 2),
    f AS (SELECT feature, v, sum(r) OVER w / sum(r) OVER p::DOUBLE AS f_ref, sum(c) OVER w / sum(c) OVER p::DOUBLE AS f_cur, lead(v) OVER w - v AS gap FROM g WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
    d AS (SELECT feature, max(abs(f_ref - f_cur)) AS ks, sum(abs(f_ref - f_cur) * coalesce(gap, 0)) AS w FROM f GROUP BY 1),
    m AS (SELECT feature, count(*) FILTER (WHERE side = 'ref') AS n, count(*) FILTER (WHERE side = 'cur') AS m, avg(v) FILTER (WHERE side = 'ref') AS mean_ref, avg(v) FILTER (WHERE side = 'cur') AS mean_cur, stddev_samp(v) FILTER (WHERE side = 'ref') AS sd FROM cells JOIN valid USING (feature) GROUP BY 1),
    lam AS (SELECT *, (sqrt(n::DOUBLE * m / (n + m)) + 0.12 + 0.11 / sqrt(n::DOUBLE * m / (n + m))) * ks AS l FROM d JOIN m USING (feature)),
    tests AS (SELECT *, CASE WHEN l < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * j * j * l * l))))) END AS p FROM lam)"""


@query("drift_ks", f"{_TESTS} SELECT feature, n AS n_reference, m AS n_current, ks, p AS p_value, p < 0.05 AS drifted FROM tests", "ks p_value")
def drift_ks(spark, sf):
    return D.drift_tests(_counts(spark, sf)).select("feature", "n_reference", "n_current", "ks", "p_value", "drifted")


@query("drift_wasserstein", f"{_TESTS} SELECT feature, w / nullif(sd, 0) AS wasserstein, (mean_cur - mean_ref) / nullif(sd, 0) AS mean_shift FROM tests", "wasserstein mean_shift")
def drift_wasserstein(spark, sf):
    return D.drift_tests(_counts(spark, sf)).select("feature", "wasserstein", "mean_shift")


@query(
    "drift_summary",
    f"{_TESTS} SELECT count(*) > 0 AS enabled, count(*) AS n_features_compared, count(*) FILTER (WHERE p < 0.05) AS n_drifted, coalesce(count(*) FILTER (WHERE p < 0.05) / nullif(count(*), 0)::DOUBLE, 0) AS share_drifted FROM tests",
    "share_drifted",
)
def drift_summary(spark, sf):
    return D.drift_verdict(D.drift_tests(_counts(spark, sf)))


# A reference kept as pairs of CSV strings, with blank tax cells (the model's median is 0.04) and a text column that is no
# feature; the logs are the later lines, in which the blank cells are absent and take the median of the reference.
_REFERENCE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_REFERENCE_CELLS = f"""lines AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '{_CUT}' THEN 'ref' ELSE 'cur' END AS side, l_quantity, l_discount,
    CASE WHEN l_partkey % 5 <> 0 THEN l_tax WHEN l_shipdate < TIMESTAMP '{_CUT}' THEN 0.04 END AS l_tax FROM lineitem),
    med AS (SELECT quantile_cont(l_tax, 0.5) AS m FROM lines WHERE side = 'ref'),
    cells AS ({" UNION ALL ".join(f"SELECT side, '{c}' AS feature, CAST({'coalesce(l_tax, m)' if c == 'l_tax' else c} AS DOUBLE) AS v FROM lines, med" for c in _REFERENCE_FEATURES)})"""


@query(
    "drift_reference_csv",
    f"{_TESTS.replace(_CELLS_SQL, _REFERENCE_CELLS)} SELECT feature, n AS n_reference, m AS n_current, ks, p AS p_value, p < 0.05 AS drifted, w / nullif(sd, 0) AS wasserstein FROM tests",
    "ks p_value wasserstein",
)
def drift_reference_csv(spark, sf):
    """The reference is written once as wide CSV, read back, and compared with all logs."""
    before = F.col("l_shipdate") < F.to_timestamp_ntz(F.lit(f"{_CUT} 00:00:00"))
    lines = table(spark, sf, "lineitem").withColumn("tax", F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")))
    cells = [F.lit('"one, two"'), "l_quantity", "l_discount", F.coalesce(F.col("tax").cast("string"), F.lit(""))]
    pairs = lines.where(before).select(F.lit("note,l_quantity,l_discount,l_tax").alias("columns_csv"), F.concat_ws(",", *cells).alias("row_csv"))
    reference = ensure_reference(pairs, scratch_path(spark, "reference-csv"), _REFERENCE_FEATURES, {"l_tax": 0.04})
    features = F.map_from_arrays(F.lit(_REFERENCE_FEATURES), F.array("l_quantity", "l_discount", "tax"))
    logs = lines.where(~before).select(features.alias("input_features"))
    tests = D.drift_tests(reference_counts(reference, logs))
    return tests.select("feature", "n_reference", "n_current", "ks", "p_value", "drifted", "wasserstein")
