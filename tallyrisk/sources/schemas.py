"""Fixed schemas of the log tables, the model table and the raw credit tables."""

from __future__ import annotations

# Column names and types of the event log.
API_CALLS = """id BIGINT, timestamp TIMESTAMP, endpoint STRING, method STRING, status_code INT,
latency_ms DOUBLE, inference_ms DOUBLE, payload_hash STRING, payload_keys ARRAY<STRING>,
input_features MAP<STRING, DOUBLE>, score DOUBLE, decision STRING, model_version STRING, error STRING"""

API_CALL_COLUMNS = [
    "timestamp",
    "endpoint",
    "method",
    "status_code",
    "latency_ms",
    "inference_ms",
    "payload_hash",
    "payload_keys",
    "input_features",
    "score",
    "decision",
    "model_version",
    "error",
]

# One row per monitoring run, both documents as JSON text.
MONITORING_RUNS = "id BIGINT, run_at TIMESTAMP, operational STRING, drift STRING"

MODEL_RUNS = "run_at TIMESTAMP, run_name STRING, parameters MAP<STRING, STRING>, metrics MAP<STRING, DOUBLE>"

MODEL_BUNDLE = "feature_names ARRAY<STRING>, medians MAP<STRING, DOUBLE>, model_version STRING"

REQUEST = "age INT, income DOUBLE, credit_amount DOUBLE, annuity DOUBLE, employment_years DOUBLE, family_members DOUBLE"

# The raw tables' keys, categories and numbers. Tables may hold more columns.
RAW_TABLES = {
    "application": """SK_ID_CURR BIGINT, TARGET INT, CODE_GENDER STRING, FLAG_OWN_CAR STRING, FLAG_OWN_REALTY STRING,
        AMT_INCOME_TOTAL DOUBLE, AMT_CREDIT DOUBLE, AMT_ANNUITY DOUBLE, AMT_GOODS_PRICE DOUBLE, CNT_FAM_MEMBERS DOUBLE,
        DAYS_BIRTH DOUBLE, DAYS_EMPLOYED DOUBLE, DAYS_ID_PUBLISH DOUBLE, DAYS_LAST_PHONE_CHANGE DOUBLE,
        OWN_CAR_AGE DOUBLE, EXT_SOURCE_1 DOUBLE, EXT_SOURCE_2 DOUBLE, EXT_SOURCE_3 DOUBLE, ORGANIZATION_TYPE STRING,
        NAME_EDUCATION_TYPE STRING, OCCUPATION_TYPE STRING""",
    "bureau": """SK_ID_CURR BIGINT, SK_ID_BUREAU BIGINT, CREDIT_ACTIVE STRING, CREDIT_TYPE STRING, DAYS_CREDIT DOUBLE,
        DAYS_CREDIT_ENDDATE DOUBLE, DAYS_ENDDATE_FACT DOUBLE, DAYS_CREDIT_UPDATE DOUBLE, CREDIT_DAY_OVERDUE DOUBLE,
        AMT_CREDIT_MAX_OVERDUE DOUBLE, AMT_CREDIT_SUM DOUBLE, AMT_CREDIT_SUM_DEBT DOUBLE,
        AMT_CREDIT_SUM_OVERDUE DOUBLE, AMT_CREDIT_SUM_LIMIT DOUBLE, AMT_ANNUITY DOUBLE, CNT_CREDIT_PROLONG DOUBLE""",
    "bureau_balance": "SK_ID_BUREAU BIGINT, MONTHS_BALANCE INT, STATUS STRING",
    "previous_application": """SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, NAME_CONTRACT_STATUS STRING,
        NAME_CONTRACT_TYPE STRING, AMT_APPLICATION DOUBLE, AMT_CREDIT DOUBLE, AMT_ANNUITY DOUBLE,
        AMT_DOWN_PAYMENT DOUBLE, AMT_GOODS_PRICE DOUBLE, RATE_DOWN_PAYMENT DOUBLE, HOUR_APPR_PROCESS_START DOUBLE,
        CNT_PAYMENT DOUBLE, DAYS_DECISION DOUBLE, DAYS_FIRST_DRAWING DOUBLE, DAYS_FIRST_DUE DOUBLE,
        DAYS_LAST_DUE_1ST_VERSION DOUBLE, DAYS_LAST_DUE DOUBLE, DAYS_TERMINATION DOUBLE""",
    "pos_cash_balance": """SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE INT, SK_DPD DOUBLE, SK_DPD_DEF DOUBLE,
        NAME_CONTRACT_STATUS STRING""",
    "installments_payments": """SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, NUM_INSTALMENT_VERSION DOUBLE,
        NUM_INSTALMENT_NUMBER INT, DAYS_INSTALMENT DOUBLE, DAYS_ENTRY_PAYMENT DOUBLE, AMT_INSTALMENT DOUBLE,
        AMT_PAYMENT DOUBLE""",
    "credit_card_balance": """SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE INT, AMT_BALANCE DOUBLE,
        AMT_CREDIT_LIMIT_ACTUAL DOUBLE, AMT_DRAWINGS_ATM_CURRENT DOUBLE, AMT_DRAWINGS_CURRENT DOUBLE,
        AMT_DRAWINGS_POS_CURRENT DOUBLE, AMT_INST_MIN_REGULARITY DOUBLE, AMT_PAYMENT_CURRENT DOUBLE,
        AMT_PAYMENT_TOTAL_CURRENT DOUBLE, AMT_RECEIVABLE_PRINCIPAL DOUBLE, AMT_TOTAL_RECEIVABLE DOUBLE,
        CNT_DRAWINGS_ATM_CURRENT DOUBLE, CNT_DRAWINGS_CURRENT DOUBLE, CNT_DRAWINGS_POS_CURRENT DOUBLE,
        SK_DPD DOUBLE, SK_DPD_DEF DOUBLE""",
}
