"""Declared schemas of the seven loan tables."""

from __future__ import annotations

# File names of the input set, by table.
FILES = {
    "app": "application_train.csv",
    "prev": "previous_application.csv",
    "bureau": "bureau.csv",
    "bureau_bal": "bureau_balance.csv",
    "pos": "POS_CASH_balance.csv",
    "inst": "installments_payments.csv",
    "card": "credit_card_balance.csv",
}

# Columns of the three tables whose types the input contract declares.
# Unsigned 32-bit ids are longs, 16/32-bit integers are ints, 32-bit floats are doubles.
DECLARED = {
    "pos": (
        "SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE INT, SK_DPD INT, SK_DPD_DEF INT, "
        "CNT_INSTALMENT DOUBLE, CNT_INSTALMENT_FUTURE DOUBLE"
    ),
    "inst": (
        "SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, NUM_INSTALMENT_NUMBER INT, NUM_INSTALMENT_VERSION DOUBLE, "
        "DAYS_INSTALMENT DOUBLE, DAYS_ENTRY_PAYMENT DOUBLE, AMT_INSTALMENT DOUBLE, AMT_PAYMENT DOUBLE"
    ),
    "card": (
        "SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE SMALLINT, AMT_CREDIT_LIMIT_ACTUAL INT, "
        "CNT_DRAWINGS_CURRENT INT, SK_DPD INT, SK_DPD_DEF INT, AMT_BALANCE DOUBLE, "
        "AMT_DRAWINGS_ATM_CURRENT DOUBLE, AMT_DRAWINGS_CURRENT DOUBLE, AMT_DRAWINGS_OTHER_CURRENT DOUBLE, "
        "AMT_DRAWINGS_POS_CURRENT DOUBLE, AMT_INST_MIN_REGULARITY DOUBLE, AMT_PAYMENT_CURRENT DOUBLE, "
        "AMT_PAYMENT_TOTAL_CURRENT DOUBLE, AMT_RECEIVABLE_PRINCIPAL DOUBLE, AMT_RECIVABLE DOUBLE, "
        "AMT_TOTAL_RECEIVABLE DOUBLE, CNT_DRAWINGS_ATM_CURRENT DOUBLE, CNT_DRAWINGS_OTHER_CURRENT DOUBLE, "
        "CNT_DRAWINGS_POS_CURRENT DOUBLE, CNT_INSTALMENT_MATURE_CUM DOUBLE"
    ),
}

# Types of the four tables whose types the input contract leaves open: keys, text columns and the columns the jobs
# use by name. The other columns, all numeric, follow NAME_RULES.
KNOWN_TYPES = {
    "app": {
        "BIGINT": ["SK_ID_CURR"],
        # The text columns.
        "STRING": [
            "NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_TYPE_SUITE", "NAME_INCOME_TYPE",
            "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "WEEKDAY_APPR_PROCESS_START",
            "ORGANIZATION_TYPE", "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE",
        ],
        "INT": [
            "TARGET", "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_ID_PUBLISH",
        ],
        "DOUBLE": [
            "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_ANNUITY", "AMT_CREDIT", "AMT_GOODS_PRICE",
            "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS", "OWN_CAR_AGE", "REGION_POPULATION_RELATIVE",
            "DAYS_REGISTRATION", "DAYS_LAST_PHONE_CHANGE",
        ],
    },
    "prev": {
        "BIGINT": ["SK_ID_CURR", "SK_ID_PREV"],
        # The text columns.
        "STRING": [
            "NAME_CONTRACT_TYPE", "WEEKDAY_APPR_PROCESS_START", "FLAG_LAST_APPL_PER_CONTRACT", "NAME_CASH_LOAN_PURPOSE",
            "NAME_CONTRACT_STATUS", "NAME_PAYMENT_TYPE", "CODE_REJECT_REASON", "NAME_TYPE_SUITE", "NAME_CLIENT_TYPE",
            "NAME_GOODS_CATEGORY", "NAME_PORTFOLIO", "NAME_PRODUCT_TYPE", "CHANNEL_TYPE", "NAME_SELLER_INDUSTRY",
            "NAME_YIELD_GROUP", "PRODUCT_COMBINATION",
        ],
        "INT": ["DAYS_DECISION"],
        "DOUBLE": [
            "AMT_APPLICATION", "AMT_CREDIT", "AMT_ANNUITY", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE",
            "RATE_DOWN_PAYMENT", "CNT_PAYMENT", "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE",
            "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION",
        ],
    },
    "bureau": {
        "BIGINT": ["SK_ID_CURR", "SK_ID_BUREAU"],
        "STRING": ["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"],
        "INT": ["DAYS_CREDIT", "CREDIT_DAY_OVERDUE"],
        "DOUBLE": [
            "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM",
            "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "AMT_ANNUITY",
        ],
    },
    "bureau_bal": {"BIGINT": ["SK_ID_BUREAU"], "STRING": ["STATUS"], "INT": ["MONTHS_BALANCE"]},
}

# Numeric columns by name; the first pattern that matches the whole name counts.
NAME_RULES = [
    (r"FLAG_.*|NFLAG_.*|REG_.*|LIVE_.*|HOUR_.*|REGION_RATING_.*|CNT_CHILDREN", "INT"),
    (r".*_(AVG|MODE|MEDI)", "DOUBLE"),
    (r"(AMT|CNT|DAYS|DEF|EXT|OBS|RATE|REGION|SELLERPLACE|OWN|CREDIT)_.*", "DOUBLE"),
]

# Inclusive bounds of the declared machine types, for the range check.
UINT32 = (0, 4294967295)
INT16 = (-32768, 32767)
INT32 = (-2147483648, 2147483647)
