"""The applicant table on the supplied data and on partial inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrisk.catalog.standins import standin
from tallyrisk.operators import joins
from tallyrisk.plans import features as P


def test_every_applicant_survives_once(spark, sf):
    app = standin(spark, sf, "application")
    # Credits of a few clients only: the others get null.
    bureau = standin(spark, sf, "bureau").where("SK_ID_CURR < 20")
    got = P.client_table({"application": app, "bureau": bureau}, groups=["CODE_GENDER"])
    kept = P.clean_applications(app)
    assert got.count() == kept.count() == got.select("SK_ID_CURR").distinct().count()
    assert got.where("SK_ID_CURR >= 20 AND BUREAU_SK_ID_BUREAU_COUNT IS NOT NULL").isEmpty()
    assert not got.where("SK_ID_CURR < 20 AND BUREAU_SK_ID_BUREAU_COUNT > 0").isEmpty()
    assert "BUREAU_INCOME_CREDIT_RATIO" in got.columns and "PAYMENT_MIN_TO_ANNUITY_RATIO" not in got.columns


def test_copies_of_an_applicant_do_not_change_the_result(spark, sf, monkeypatch):
    app = standin(spark, sf, "application")
    copies = app.unionByName(app.where("SK_ID_CURR = 3").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("copy"))
    previous = standin(spark, sf, "previous_application")
    plain = P.client_table({"application": app, "previous_application": previous}, groups=[])
    monkeypatch.setattr(joins.spread_joins, "__defaults__", ("left", 50, None))
    many = P.client_table({"application": copies, "previous_application": previous}, groups=[])
    assert many.where("SK_ID_CURR = 3").count() == 301
    pick = ["SK_ID_CURR", "PREVIOUS_AMT_CREDIT_SUM", "PREVIOUS_APPROVED_AMT_CREDIT_MEAN"]
    a = plain.select(*pick).distinct().selectExpr("SK_ID_CURR", "round(PREVIOUS_AMT_CREDIT_SUM, 2) s", "round(PREVIOUS_APPROVED_AMT_CREDIT_MEAN, 2) m")
    b = many.select(*pick).distinct().selectExpr("SK_ID_CURR", "round(PREVIOUS_AMT_CREDIT_SUM, 2) s", "round(PREVIOUS_APPROVED_AMT_CREDIT_MEAN, 2) m").distinct()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_open_loans_are_found_before_the_sentinel_is_blanked(spark):
    schema = "SK_ID_PREV INT, SK_ID_CURR INT, NAME_CONTRACT_STATUS STRING, DAYS_LAST_DUE DOUBLE, DAYS_FIRST_DUE DOUBLE, AMT_APPLICATION DOUBLE, AMT_CREDIT DOUBLE, AMT_ANNUITY DOUBLE, AMT_DOWN_PAYMENT DOUBLE, CNT_PAYMENT DOUBLE"
    loans = spark.createDataFrame([(1, 1, "Approved", 365243.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 1, "Approved", 9.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0)], schema)
    rows = P.previous_measures(loans)
    assert [(r["IS_OPEN"], r["DAYS_LAST_DUE"]) for r in rows.orderBy("SK_ID_PREV").collect()] == [(1, None), (0, 9.0)]
    paid = spark.createDataFrame([(1, 10.0, 5.0), (1, 10.0, None), (2, 1.0, 1.0)], "SK_ID_PREV INT, AMT_INSTALMENT DOUBLE, AMT_PAYMENT DOUBLE")
    assert P.open_loan_repayment(rows, paid).first()["PREVIOUS_TOTAL_REPAYMENT_RATIO"] == 0.25


def test_late_means_after_the_due_day(spark):
    pay = spark.createDataFrame(
        [(-10.0, None), (-10.0, -5.0), (-10.0, -15.0)], "DAYS_INSTALMENT DOUBLE, DAYS_ENTRY_PAYMENT DOUBLE"
    ).selectExpr("*", "100D AS AMT_INSTALMENT", "0D AS AMT_PAYMENT")
    got = [(r["DPD"], r["DBD"], r["LATE_PAYMENT"]) for r in P.instalment_measures(pay).collect()]
    assert got == [(None, None, 0), (5.0, 0.0, 1), (0.0, 5.0, 0)]


@pytest.mark.parametrize("name", ["installments_payments", "credit_card_balance"])
def test_clients_above_the_limit_get_the_same_features(spark, sf, name):
    """Some clients are gathered by their rows, others (and a client without a number) are folded before the shuffle."""
    rows = standin(spark, sf, name).withColumn("SK_ID_CURR", F.when(F.col("SK_ID_CURR") % 40 != 0, F.col("SK_ID_CURR")))
    features = P.instalment_features if name == "installments_payments" else P.card_features
    sizes = [r["count"] for r in rows.where("SK_ID_CURR IS NOT NULL").groupBy("SK_ID_CURR").count().collect()]
    limit = sorted(sizes)[-4]
    assert min(sizes) < limit < max(sizes)
    want, got = features(rows), features(rows, limit=limit)
    assert got.dtypes == want.dtypes
    a, b = (x.toPandas().set_index("SK_ID_CURR").sort_index().astype(float) for x in (got, want))
    assert a.index.tolist() == b.index.tolist() and len(a) == len(sizes)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-9)
