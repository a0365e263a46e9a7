"""Client-level feature tables from the raw credit tables, and the joined applicant table.

Every child table is folded to one row per client in its own shuffle on the client key, then
joined to the applicants. Column names follow one rule: ``PREFIX_COLUMN_STAT`` in capitals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyrisk.functions import scalar as S
from tallyrisk.operators import aggregate as A
from tallyrisk.operators.joins import ROWS_PER_TASK, attach_children, fold_by_key, lookup_join, members_of, pairs_with, spread_join, spread_joins
from tallyrisk.operators.windows import last_k, last_non_null, trend_aggs

CLIENT = "SK_ID_CURR"
CREDIT = "SK_ID_BUREAU"
LOAN = "SK_ID_PREV"

Vocab = Mapping[str, Sequence[str]]


def _slices(base: str, parts: Mapping[str, Column]) -> dict[str, Column]:
    return {base: F.lit(True), **{f"{base}_{name}": cond for name, cond in parts.items()}}


# --- applicants -----------------------------------------------------------------------------

# Applicant ratios as name, numerator, denominator.
APPLICATION_RATIOS = [
    ("DAYS_EMPLOYED_PERC", "DAYS_EMPLOYED", "DAYS_BIRTH"),
    ("INCOME_CREDIT_PERC", "AMT_INCOME_TOTAL", "AMT_CREDIT"),
    ("INCOME_PER_PERSON", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    ("ANNUITY_INCOME_PERC", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    ("PAYMENT_RATE", "AMT_ANNUITY", "AMT_CREDIT"),
    ("CREDIT_TO_ANNUITY_RATIO", "AMT_CREDIT", "AMT_ANNUITY"),
    ("CREDIT_TO_GOODS_RATIO", "AMT_CREDIT", "AMT_GOODS_PRICE"),
    ("ANNUITY_TO_INCOME_RATIO", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    ("CREDIT_TO_INCOME_RATIO", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
    ("INCOME_TO_EMPLOYED_RATIO", "AMT_INCOME_TOTAL", "DAYS_EMPLOYED"),
    ("INCOME_TO_BIRTH_RATIO", "AMT_INCOME_TOTAL", "DAYS_BIRTH"),
    ("EMPLOYED_TO_BIRTH_RATIO", "DAYS_EMPLOYED", "DAYS_BIRTH"),
    ("ID_TO_BIRTH_RATIO", "DAYS_ID_PUBLISH", "DAYS_BIRTH"),
    ("CAR_TO_BIRTH_RATIO", "OWN_CAR_AGE", "DAYS_BIRTH"),
    ("CAR_TO_EMPLOYED_RATIO", "OWN_CAR_AGE", "DAYS_EMPLOYED"),
    ("PHONE_TO_BIRTH_RATIO", "DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
EXT_WEIGHTS = {"EXT_SOURCE_1": 2, "EXT_SOURCE_2": 1, "EXT_SOURCE_3": 3}
INCOME_CAP = 20000000
GROUP_COLUMNS = ["ORGANIZATION_TYPE", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "AGE_RANGE", "CODE_GENDER"]
GROUP_STATS = {
    "EXT_SOURCES_MEAN": ["median", "std"],
    "AMT_INCOME_TOTAL": ["mean", "std"],
    "CREDIT_TO_ANNUITY_RATIO": ["mean", "std"],
    "AMT_CREDIT": ["mean"],
    "AMT_ANNUITY": ["mean", "std"],
}


def with_ratios(df: DataFrame, ratios: Sequence[tuple[str, str, str]] = APPLICATION_RATIOS) -> DataFrame:
    """Add the ratios whose columns exist."""
    present = set(df.columns)
    return df.withColumns({n: S.safe_ratio(a, b) for n, a, b in ratios if a in present and b in present})


def clean_applications(df: DataFrame) -> DataFrame:
    """Drop the junk gender and extreme incomes, blank out sentinels."""
    df = df.where(S.not_value("CODE_GENDER", "XNA") & (F.col("AMT_INCOME_TOTAL") < INCOME_CAP))
    df = S.sentinel_to_null(df, ["DAYS_EMPLOYED"])
    return S.sentinel_to_null(df, ["DAYS_LAST_PHONE_CHANGE"], 0)


def application_measures(df: DataFrame) -> DataFrame:
    """Row-wise measures of the applicant: documents, age bucket, external scores, ratios."""
    documents = [c for c in df.columns if "FLAG_DOC" in c]
    extra: dict[str, Column] = {"AGE_RANGE": S.age_bucket("DAYS_BIRTH")}
    if documents:
        extra["DOCUMENT_COUNT"] = S.row_sum(documents)
        extra["NEW_DOC_KURT"] = S.row_kurtosis(documents)
    if set(EXT_SOURCES) <= set(df.columns):
        extra |= {
            "EXT_SOURCES_PROD": S.row_product(EXT_SOURCES),
            "EXT_SOURCES_WEIGHTED": S.row_weighted_sum(EXT_WEIGHTS),
            "EXT_SOURCES_MIN": S.row_min(EXT_SOURCES),
            "EXT_SOURCES_MAX": S.row_max(EXT_SOURCES),
            "EXT_SOURCES_MEAN": S.row_mean(EXT_SOURCES),
            "EXT_SOURCES_NANMEDIAN": S.row_median(EXT_SOURCES),
            "EXT_SOURCES_VAR": S.row_variance(EXT_SOURCES),
        }
    return with_ratios(df.withColumns(extra))


def application_features(df: DataFrame, groups: Sequence[str] = GROUP_COLUMNS) -> DataFrame:
    """Cleaned applicants with measures and group statistics."""
    rows = application_measures(clean_applications(df))
    stats = {c: s for c, s in GROUP_STATS.items() if c in rows.columns}
    return A.with_group_stats(rows, [g for g in groups if g in rows.columns], stats)


# --- bureau ---------------------------------------------------------------------------------

# Bureau statistics, credit types and recency limits (months).
BUREAU_STATS = {
    "SK_ID_BUREAU": ["count"],
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "CREDIT_DURATION": ["mean"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_ENDDATE_FACT": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "DEBT_PERCENTAGE": ["mean"],
    "DEBT_CREDIT_DIFF": ["mean"],
    "CREDIT_TO_ANNUITY_RATIO": ["mean"],
    "ENDDATE_DIF": ["mean"],
    "BB_MONTHS_BALANCE_MIN": ["min"],
    "BB_MONTHS_BALANCE_MAX": ["max"],
    "BB_MONTHS_BALANCE_SIZE": ["mean", "sum"],
    "STATUS_12345": ["mean"],
    "LL_AMT_CREDIT_SUM_MEAN": ["mean"],
    "LL_STATUS_12345_MEAN": ["mean"],
}
CREDIT_TYPES = ["Consumer credit", "Credit card", "Mortgage", "Car loan", "Microloan"]
BUREAU_MONTHS = [6, 12]
ARREARS = ["1", "2", "3", "4", "5"]


def month_aggregates(balance: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """Monthly balance rows to one row per credit: month range and status shares."""
    if statuses is None:
        statuses = A.vocabularies(balance, ["STATUS"]).get("STATUS", [])
    spec = {"MONTHS_BALANCE": ["min", "max", "mean", "size"]}
    aggs = [*A.build_aggs(spec, "BB_"), *A.share_aggs({"STATUS": statuses}, "BB_", with_null=False)]
    return balance.where(F.col(CREDIT).isNotNull()).groupBy(CREDIT).agg(*aggs)


def bureau_measures(bureau: DataFrame) -> DataFrame:
    return bureau.withColumns(
        {
            "CREDIT_DURATION": F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_CREDIT"),
            "ENDDATE_DIF": F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_ENDDATE_FACT"),
            "DEBT_PERCENTAGE": S.safe_ratio("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"),
            "DEBT_CREDIT_DIFF": F.col("AMT_CREDIT_SUM") - F.col("AMT_CREDIT_SUM_DEBT"),
            "CREDIT_TO_ANNUITY_RATIO": S.safe_ratio("AMT_CREDIT_SUM", "AMT_ANNUITY"),
        }
    )


def bureau_rows(bureau: DataFrame, balance: DataFrame | None) -> DataFrame:
    """Credits with measures, month aggregates, arrears share and the statistics of credits with
    the same number of months."""
    rows = bureau_measures(bureau)
    if balance is None:
        return rows
    months = month_aggregates(balance)
    rows = spread_joins(rows, [months], [CREDIT], counted=bureau)
    arrears = [c for c in months.columns if c in {f"BB_STATUS_{s}_MEAN" for s in ARREARS}]
    rows = rows.withColumn("STATUS_12345", S.row_sum(arrears) if arrears else F.lit(0.0))
    per_length = rows.where(F.col("BB_MONTHS_BALANCE_SIZE").isNotNull()).groupBy("BB_MONTHS_BALANCE_SIZE").agg(
        F.avg("AMT_CREDIT_SUM").alias("LL_AMT_CREDIT_SUM_MEAN"), F.avg("STATUS_12345").alias("LL_STATUS_12345_MEAN")
    )
    return lookup_join(rows, per_length, ["BB_MONTHS_BALANCE_SIZE"])


def bureau_features(bureau: DataFrame, balance: DataFrame | None = None, vocab: Vocab | None = None) -> DataFrame:
    """External credits per client: all, active, closed, by type, recent; last overdue, debt ratios."""
    rows = bureau_rows(bureau, balance)
    if vocab is None:
        vocab = A.vocabularies(bureau, A.text_columns(bureau))
    spec = {c: s for c, s in BUREAU_STATS.items() if c in rows.columns}
    spec |= {c: ["mean"] for c in rows.columns if c.startswith("BB_STATUS_")}
    parts = {
        "ACTIVE": F.col("CREDIT_ACTIVE") == "Active",
        "CLOSED": F.col("CREDIT_ACTIVE") == "Closed",
        **{S.clean_name(t).upper(): F.col("CREDIT_TYPE") == t for t in CREDIT_TYPES},
        **{f"LAST{m}M": F.col("DAYS_CREDIT") >= -30 * m for m in BUREAU_MONTHS},
    }
    wide = A.sliced_stats(rows, CLIENT, _slices("BUREAU", parts), spec, vocab, counted=bureau)
    order = F.struct("DAYS_CREDIT", CREDIT)
    overdue = last_non_null(bureau, CLIENT, "AMT_CREDIT_MAX_OVERDUE", order, "BUREAU_LAST_LOAN_MAX_OVERDUE")
    debt, credit = "AMT_CREDIT_SUM_DEBT_SUM", "AMT_CREDIT_SUM_SUM"
    ratios = [
        ("BUREAU_DEBT_OVER_CREDIT", f"BUREAU_{debt}", f"BUREAU_{credit}"),
        ("BUREAU_ACTIVE_DEBT_OVER_CREDIT", f"BUREAU_ACTIVE_{debt}", f"BUREAU_ACTIVE_{credit}"),
    ]
    return with_ratios(wide, ratios).join(overdue, CLIENT, "left")


# --- previous applications --------------------------------------------------------------------

# Statistics, dates that use the sentinel, recency limits (months).
PREVIOUS_STATS = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean", "sum"],
    "APPLICATION_CREDIT_RATIO": ["min", "max", "mean", "var"],
    "APPLICATION_CREDIT_DIFF": ["min", "max", "mean"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean", "var"],
    "CNT_PAYMENT": ["max", "mean", "sum"],
    "CREDIT_TO_ANNUITY_RATIO": ["mean"],
    "DOWN_PAYMENT_TO_CREDIT": ["mean"],
    "SIMPLE_INTERESTS": ["mean"],
    "DAYS_LAST_DUE_DIFF": ["mean"],
}
PREVIOUS_DATES = ["DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION"]
PREVIOUS_MONTHS = [12, 24]


def previous_measures(previous: DataFrame) -> DataFrame:
    """Measures per earlier application. An open loan has the sentinel as its last due day, so the
    flag is taken before the sentinel is blanked out."""
    rows = previous.withColumn("IS_OPEN", S.flag(F.col("DAYS_LAST_DUE") == S.DAYS_SENTINEL))
    rows = S.sentinel_to_null(rows, PREVIOUS_DATES)
    return rows.withColumns(
        {
            "DAYS_LAST_DUE_DIFF": F.col("DAYS_LAST_DUE") - F.col("DAYS_FIRST_DUE"),
            "APPLICATION_CREDIT_DIFF": F.col("AMT_APPLICATION") - F.col("AMT_CREDIT"),
            "APPLICATION_CREDIT_RATIO": S.safe_ratio("AMT_APPLICATION", "AMT_CREDIT"),
            "CREDIT_TO_ANNUITY_RATIO": S.safe_ratio("AMT_CREDIT", "AMT_ANNUITY"),
            "DOWN_PAYMENT_TO_CREDIT": S.safe_ratio("AMT_DOWN_PAYMENT", "AMT_CREDIT"),
            "SIMPLE_INTERESTS": S.safe_ratio(F.col("AMT_ANNUITY") * F.col("CNT_PAYMENT"), "AMT_CREDIT") - F.lit(1),
        }
    )


def open_loan_repayment(rows: DataFrame, payments: DataFrame) -> DataFrame:
    """Mean share of the instalments that was paid, over the client's open approved loans that have
    payments."""
    open_loans = rows.where((F.col("NAME_CONTRACT_STATUS") == "Approved") & (F.col("IS_OPEN") == 1))
    paid = members_of(payments, open_loans, LOAN).groupBy(LOAN).agg(
        F.coalesce(F.sum("AMT_INSTALMENT"), F.lit(0.0)).alias("due"),
        F.coalesce(F.sum("AMT_PAYMENT"), F.lit(0.0)).alias("paid"),
    )
    joined = spread_join(open_loans.select(LOAN, CLIENT), paid, [LOAN])
    return joined.groupBy(CLIENT).agg(F.avg(S.safe_ratio("paid", "due")).alias("PREVIOUS_TOTAL_REPAYMENT_RATIO"))


def late_payment_share(payments: DataFrame) -> DataFrame:
    late = S.flag(F.col("DAYS_ENTRY_PAYMENT") > F.col("DAYS_INSTALMENT"))
    rows = payments.where(F.col(CLIENT).isNotNull()).withColumn("LATE_PAYMENT", late)
    spec = {"LATE_PAYMENT": ["mean", "sum"], "DAYS_INSTALMENT": ["mean"]}
    return rows.groupBy(CLIENT).agg(*A.build_aggs(spec, "PREVIOUS_LATE_"))


def previous_features(previous: DataFrame, payments: DataFrame | None = None, vocab: Vocab | None = None) -> DataFrame:
    """Earlier applications per client: all, approved, refused, consumer, cash, recent."""
    rows = previous_measures(previous)
    if vocab is None:
        vocab = A.vocabularies(previous, A.text_columns(previous))
    spec = {c: s for c, s in PREVIOUS_STATS.items() if c in rows.columns}
    parts = {
        "APPROVED": F.col("NAME_CONTRACT_STATUS") == "Approved",
        "REFUSED": F.col("NAME_CONTRACT_STATUS") == "Refused",
        "CONSUMER": F.col("NAME_CONTRACT_TYPE") == "Consumer loans",
        "CASH": F.col("NAME_CONTRACT_TYPE") == "Cash loans",
        **{f"LAST{m}M": F.col("DAYS_DECISION") >= -30 * m for m in PREVIOUS_MONTHS},
    }
    wide = A.sliced_stats(rows, CLIENT, _slices("PREVIOUS", parts), spec, vocab, counted=previous)
    if payments is None:
        return wide
    return attach_children(wide, [late_payment_share(payments), open_loan_repayment(rows, payments)], CLIENT)


def _per_client(rows: DataFrame, aggs: Sequence[Column], counted: DataFrame) -> DataFrame:
    def fold(part: DataFrame) -> DataFrame:
        return part.groupBy(CLIENT).agg(*aggs)

    return fold_by_key(rows, CLIENT, fold, fold, counted=counted)


# --- POS cash -----------------------------------------------------------------------------------

# Fixed values.
POS_STATS = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
    "LATE_PAYMENT": ["mean", "sum"],
}
POS_LAST_LOANS = 3


def pos_loans(rows: DataFrame) -> DataFrame:
    """One row per loan: newest month, late months, completed shares, remaining instalments."""
    done = A.indicator("NAME_CONTRACT_STATUS", "Completed")
    loans = rows.where(F.col(LOAN).isNotNull()).groupBy(LOAN).agg(
        F.max("MONTHS_BALANCE").alias("MONTHS_BALANCE_MAX"),
        F.sum("LATE_PAYMENT").alias("LATE_PAYMENT_SUM"),
        F.avg(done).alias("LOAN_COMPLETED_MEAN"),
        F.avg(F.when(F.col("MONTHS_BALANCE") < -1, done)).alias("COMPLETED_BEFORE_MEAN"),
    )
    remaining = -F.col("MONTHS_BALANCE_MAX")
    return loans.withColumns(
        {
            "REMAINING_INSTALMENTS": remaining,
            "REMAINING_INSTALMENTS_RATIO": S.safe_ratio(remaining, F.abs("MONTHS_BALANCE_MAX") + F.lit(1)),
        }
    )


def pos_features(pos: DataFrame, vocab: Vocab | None = None) -> DataFrame:
    """POS months per client, the mean over the client's loans, late months of the last 3 loans."""
    rows = pos.withColumn("LATE_PAYMENT", S.flag(F.col("SK_DPD") > 0))
    if vocab is None:
        vocab = A.vocabularies(pos, A.text_columns(pos))
    keyed = rows.where(F.col(CLIENT).isNotNull())
    aggs = [*A.build_aggs(POS_STATS, "POS_"), *A.share_aggs(vocab, "POS_"), F.count(F.lit(1)).alias("POS_COUNT")]
    base = _per_client(rows, aggs, pos)
    pairs = pairs_with(keyed, [CLIENT, LOAN], pos_loans(rows), LOAN)
    means = ["MONTHS_BALANCE_MAX", "LOAN_COMPLETED_MEAN", "COMPLETED_BEFORE_MEAN", "REMAINING_INSTALMENTS", "REMAINING_INSTALMENTS_RATIO"]
    per_client = pairs.groupBy(CLIENT).agg(*[F.avg(c).alias(f"POS_LOANS_{c}") for c in means])
    newest = [F.col("MONTHS_BALANCE_MAX").desc_nulls_last(), F.col(LOAN).desc()]
    recent = last_k(pairs, CLIENT, newest, POS_LAST_LOANS).groupBy(CLIENT).agg(
        F.avg("LATE_PAYMENT_SUM").alias("POS_RECENT3_LATE_PAYMENT_MEAN")
    )
    return attach_children(base, [per_client, recent], CLIENT)


# --- instalments ----------------------------------------------------------------------------------

# Fixed values.
INSTALMENT_STATS = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFFERENCE": ["max", "mean"],
    "PAYMENT_RATIO": ["max", "mean"],
    "PAID_OVER_AMOUNT": ["max", "mean"],
    "PAID_OVER": ["mean"],
    "LATE_PAYMENT": ["mean", "sum"],
    "LATE_PAYMENT_RATIO": ["mean"],
    "SIGNIFICANT_LATE_PAYMENT": ["mean"],
    "DPD_7": ["mean"],
    "DPD_15": ["mean"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
INSTALMENT_MONTHS = [36, 60]
TREND_ROWS = [12, 24, 60, 120]
OVERPAID = 1.05
INSTALMENT_LAST = {
    "PAYMENT_RATIO": "INS_LAST_PAYMENT_RATIO",
    "PAYMENT_DIFFERENCE": "INS_LAST_PAYMENT_DIFF",
    "DPD": "INS_LAST_DPD",
    "PAID_OVER_AMOUNT": "INS_LAST_PAID_OVER_AMOUNT",
}


def instalment_measures(payments: DataFrame) -> DataFrame:
    """Row measures of one payment that need no other row."""
    late_days = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    rows = payments.withColumns(
        {
            "PAYMENT_PERC": S.safe_ratio("AMT_PAYMENT", "AMT_INSTALMENT"),
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "DPD": S.positive_part(late_days),
            "DBD": S.positive_part(-late_days),
        }
    )
    return rows.withColumns(
        {
            "LATE_PAYMENT": S.flag(F.col("DPD") > 0),
            "DPD_7": S.flag(F.col("DPD") > 7),
            "DPD_15": S.flag(F.col("DPD") > 15),
        }
    )


def instalment_rows(payments: DataFrame) -> DataFrame:
    """Payments with the measures that use the instalment's total (several payments per instalment)."""
    rows = A.with_group_total(payments, [LOAN, "NUM_INSTALMENT_NUMBER"], "AMT_PAYMENT", "AMT_PAYMENT_GROUPED")
    rows = instalment_measures(rows)
    over = F.col("AMT_PAYMENT_GROUPED") - F.col("AMT_INSTALMENT")
    ratio = S.safe_ratio("AMT_PAYMENT_GROUPED", "AMT_INSTALMENT")
    return rows.withColumns(
        {
            "PAYMENT_DIFFERENCE": over,
            "PAID_OVER_AMOUNT": over,
            "PAID_OVER": S.flag(over > 0),
            "PAYMENT_RATIO": ratio,
            "SIGNIFICANT_LATE_PAYMENT": S.flag(ratio > OVERPAID),
            "LATE_PAYMENT_RATIO": S.safe_ratio("LATE_PAYMENT", "AMT_PAYMENT_GROUPED"),
        }
    )


def newest_instalment() -> list[Column]:
    """Newest due day first; loan, number and amounts break ties, so the order is total up to
    identical rows."""
    return [
        F.col("DAYS_INSTALMENT").desc_nulls_last(),
        F.col(LOAN).desc(),
        F.col("NUM_INSTALMENT_NUMBER").desc(),
        F.col("DAYS_ENTRY_PAYMENT").desc_nulls_last(),
        F.col("AMT_INSTALMENT").desc_nulls_last(),
        F.col("AMT_PAYMENT").desc_nulls_last(),
    ]


def instalment_features(payments: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Payments per client: all, last 36 and 60 months, trends, newest payment."""
    rows = instalment_rows(payments)
    parts = {f"LAST{m}M": F.col("DAYS_INSTALMENT") >= -30 * m for m in INSTALMENT_MONTHS}
    slices = _slices("INS", parts)
    newest = [F.max(F.when(F.col("rn") == 1, F.col(c))).alias(name) for c, name in INSTALMENT_LAST.items()]
    more = [*trend_aggs(["DPD", "PAID_OVER_AMOUNT"], TREND_ROWS, "INS_"), *newest]
    size = F.count(F.lit(1)).alias("INS_COUNT")

    def fold(part: DataFrame) -> DataFrame:
        line = Window.partitionBy(CLIENT).orderBy(*newest_instalment())
        marked, aggs = A.slice_columns(part.withColumn("rn", F.row_number().over(line)), slices, INSTALMENT_STATS, {})
        return marked.groupBy(CLIENT).agg(*aggs, size, *more)

    def spread(part: DataFrame) -> DataFrame:
        names = [A.out_name("", c, s) for c, stats in INSTALMENT_STATS.items() for s in stats]
        wide = A.slice_aggregate(part, CLIENT, slices, A.build_aggs(INSTALMENT_STATS), names)
        recent = last_k(part, CLIENT, newest_instalment(), max(TREND_ROWS))
        return attach_children(wide, [part.groupBy(CLIENT).agg(size), recent.groupBy(CLIENT).agg(*more)], CLIENT)

    return fold_by_key(rows, CLIENT, fold, spread, newest_instalment(), payments, limit)


# --- credit card -----------------------------------------------------------------------------------

# Fixed values.
CARD_STATS = ["min", "max", "mean", "sum", "var"]
CARD_WINDOW_STATS = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "AMT_BALANCE": ["mean", "max"],
    "AMT_CREDIT_LIMIT_ACTUAL": ["max", "mean"],
    "AMT_DRAWINGS_ATM_CURRENT": ["mean"],
    "AMT_DRAWINGS_CURRENT": ["mean"],
    "AMT_DRAWINGS_POS_CURRENT": ["mean"],
    "AMT_INST_MIN_REGULARITY": ["mean"],
    "AMT_PAYMENT_CURRENT": ["mean"],
    "AMT_PAYMENT_TOTAL_CURRENT": ["mean"],
    "AMT_RECEIVABLE_PRINCIPAL": ["mean"],
    "AMT_TOTAL_RECEIVABLE": ["mean"],
    "CNT_DRAWINGS_ATM_CURRENT": ["mean"],
    "CNT_DRAWINGS_CURRENT": ["mean"],
    "CNT_DRAWINGS_POS_CURRENT": ["mean"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
    "LIMIT_USE": ["mean", "max"],
    "PAYMENT_DIV_MIN": ["mean"],
    "LATE_PAYMENT": ["mean"],
    "DRAWING_LIMIT_RATIO": ["mean"],
}
CARD_MONTHS = [12, 24, 48]
CARD_LAST = {
    "AMT_BALANCE": "CC_LAST_AMT_BALANCE",
    "AMT_DRAWINGS_CURRENT": "CC_LAST_DRAWING",
    "AMT_PAYMENT_TOTAL_CURRENT": "CC_LAST_PAYMENT",
    "LIMIT_USE": "CC_LAST_LIMIT_USE",
}


def card_measures(card: DataFrame) -> DataFrame:
    if "AMT_RECIVABLE" in card.columns:
        card = card.withColumnRenamed("AMT_RECIVABLE", "AMT_RECEIVABLE")
    present = set(card.columns)
    ratios = [
        ("LIMIT_USE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"),
        ("PAYMENT_DIV_MIN", "AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULARITY"),
        ("DRAWING_LIMIT_RATIO", "AMT_DRAWINGS_ATM_CURRENT", "AMT_CREDIT_LIMIT_ACTUAL"),
    ]
    rows = with_ratios(card, [r for r in ratios if {r[1], r[2]} <= present])
    return rows.withColumn("LATE_PAYMENT", S.flag(F.col("SK_DPD") > 0))


def card_features(card: DataFrame, vocab: Vocab | None = None, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Card months per client: every numeric column with five stats, category shares, recent
    windows, the newest month per card."""
    rows = card_measures(card)
    if vocab is None:
        vocab = A.vocabularies(card, A.text_columns(card))
    everything = {c: CARD_STATS for c in A.numeric_columns(rows, without=[CLIENT, LOAN])}
    whole = [*A.build_aggs(everything, "CC_"), *A.share_aggs(vocab, "CC_"), F.count(F.lit(1)).alias("CC_COUNT")]
    spec = {c: s for c, s in CARD_WINDOW_STATS.items() if c in rows.columns}
    slices = {f"CC_LAST{m}M": F.col("MONTHS_BALANCE") >= -m for m in CARD_MONTHS}

    def fold(part: DataFrame) -> DataFrame:
        marked, aggs = A.slice_columns(part, slices, spec, vocab)
        return marked.groupBy(CLIENT).agg(*whole, *aggs)

    def spread(part: DataFrame) -> DataFrame:
        recent = A.folded_stats(part, CLIENT, slices, spec, vocab)
        return attach_children(part.groupBy(CLIENT).agg(*whole), [recent], CLIENT)

    base = fold_by_key(rows, CLIENT, fold, spread, counted=card, limit=limit)
    values = [c for c in CARD_LAST if c in rows.columns]
    newest = [F.col("MONTHS_BALANCE").desc(), *[F.col(c).desc_nulls_last() for c in values], F.col(CLIENT).desc()]
    last = last_k(rows.where(F.col(LOAN).isNotNull()).select(LOAN, CLIENT, "MONTHS_BALANCE", *values), LOAN, newest, 1)
    per_client = last.groupBy(CLIENT).agg(*[F.avg(c).alias(CARD_LAST[c]) for c in values])
    return attach_children(base, [per_client], CLIENT)


# --- the joined table ---------------------------------------------------------------------------------

# Ratios between tables as name, numerator, denominator.
CROSS_RATIOS = [
    ("BUREAU_INCOME_CREDIT_RATIO", "BUREAU_AMT_CREDIT_SUM_SUM", "AMT_INCOME_TOTAL"),
    ("BUREAU_ACTIVE_CREDIT_TO_INCOME_RATIO", "BUREAU_ACTIVE_AMT_CREDIT_SUM_SUM", "AMT_INCOME_TOTAL"),
    ("CURRENT_TO_APPROVED_CREDIT_MIN_RATIO", "AMT_CREDIT", "PREVIOUS_APPROVED_AMT_CREDIT_MIN"),
    ("CURRENT_TO_APPROVED_CREDIT_MAX_RATIO", "AMT_CREDIT", "PREVIOUS_APPROVED_AMT_CREDIT_MAX"),
    ("CURRENT_TO_APPROVED_CREDIT_MEAN_RATIO", "AMT_CREDIT", "PREVIOUS_APPROVED_AMT_CREDIT_MEAN"),
    ("CURRENT_TO_APPROVED_ANNUITY_MAX_RATIO", "AMT_ANNUITY", "PREVIOUS_APPROVED_AMT_ANNUITY_MAX"),
    ("CURRENT_TO_APPROVED_ANNUITY_MEAN_RATIO", "AMT_ANNUITY", "PREVIOUS_APPROVED_AMT_ANNUITY_MEAN"),
    ("PAYMENT_MIN_TO_ANNUITY_RATIO", "INS_AMT_PAYMENT_MIN", "AMT_ANNUITY"),
    ("PAYMENT_MAX_TO_ANNUITY_RATIO", "INS_AMT_PAYMENT_MAX", "AMT_ANNUITY"),
    ("PAYMENT_MEAN_TO_ANNUITY_RATIO", "INS_AMT_PAYMENT_MEAN", "AMT_ANNUITY"),
    ("CTA_CREDIT_TO_ANNUITY_RATIO", "AMT_CREDIT", "AMT_ANNUITY"),
    ("DAYS_DECISION_MEAN_TO_BIRTH", "PREVIOUS_DAYS_DECISION_MEAN", "DAYS_BIRTH"),
    ("DAYS_CREDIT_MEAN_TO_BIRTH", "BUREAU_DAYS_CREDIT_MEAN", "DAYS_BIRTH"),
    ("DAYS_DECISION_MEAN_TO_EMPLOYED", "PREVIOUS_DAYS_DECISION_MEAN", "DAYS_EMPLOYED"),
    ("DAYS_CREDIT_MEAN_TO_EMPLOYED", "BUREAU_DAYS_CREDIT_MEAN", "DAYS_EMPLOYED"),
]


def cross_ratios(df: DataFrame) -> DataFrame:
    return with_ratios(df, CROSS_RATIOS)


def client_table(tables: Mapping[str, DataFrame], groups: Sequence[str] = GROUP_COLUMNS) -> DataFrame:
    """One row per applicant from whichever raw tables are there (``application`` is required)."""
    get = tables.get
    children = []
    if get("bureau") is not None:
        children.append(bureau_features(tables["bureau"], get("bureau_balance")))
    if get("previous_application") is not None:
        children.append(previous_features(tables["previous_application"], get("installments_payments")))
    if get("pos_cash_balance") is not None:
        children.append(pos_features(tables["pos_cash_balance"]))
    if get("installments_payments") is not None:
        children.append(instalment_features(tables["installments_payments"]))
    if get("credit_card_balance") is not None:
        children.append(card_features(tables["credit_card_balance"]))
    applicants = tables["application"]
    joined = spread_joins(application_features(applicants, groups), children, [CLIENT], counted=applicants)
    return cross_ratios(joined)
