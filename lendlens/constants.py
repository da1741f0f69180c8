"""Word lists, lookup tables and constants that results depend on."""

# Ordered categories; the code of a level is its position, unknown levels get -1.
ORDINAL_LEVELS = {
    "customer_credit_score_range": ["poor", "fair", "good", "excellent"],
    "customer_age_bracket": ["18-24", "25-34", "35-44", "45-54", "55+"],
    "customer_income_bracket": ["<25k", "25k-50k", "50k-75k", "75k-100k", "100k+"],
    "customer_verification_level": ["unverified", "partial", "verified"],
    "product_risk_category": ["low", "medium", "high"],
    "risk_level": ["low", "medium", "high"],
}
UNKNOWN_CODE = -1.0

# Unordered categories that become 0/1 columns.
NOMINAL_COLUMNS = [
    "device_type", "payment_provider", "product_category",
    "purchase_context", "risk_scenario", "time_of_day",
]

BOOLEAN_COLUMNS = ["will_default", "device_is_trusted"]

# The transaction projection, in output order.
TRANSACTION_COLUMNS = [
    "customer_id", "transaction_id", "amount", "will_default", "transaction_timestamp",
    "days_to_first_missed_payment", "customer_credit_score_range", "customer_age_bracket",
    "customer_income_bracket", "customer_verification_level", "customer_tenure_days",
    "customer_state", "product_category", "product_risk_category", "product_price",
    "device_type", "device_is_trusted", "risk_score", "risk_level", "risk_scenario",
    "payment_provider", "installment_count", "payment_credit_limit", "payment_type",
    "time_on_site_seconds", "purchase_context", "price_comparison_time",
]

# Columns that never reach the model.
IDENTIFIER_COLUMNS = [
    "customer_id", "transaction_id", "record_id", "unique_transaction_id",
    "unique_customer_id", "first_customer_transaction_date", "first_customer_tenure",
    "days_from_first_transaction", "device_id", "product_id", "transaction_timestamp",
    "ingestion_timestamp",
]
RAW_TEMPORAL_COLUMNS = [
    "transaction_timestamp", "transaction_hour", "transaction_day_of_week",
    "transaction_month", "transaction_day_of_month",
]
UNNEEDED_COLUMNS = [
    "_generator", "_timestamp", "currency", "customer_state", "device_os",
    "payment_frequency", "payment_method_id", "payment_type", "product_price", "status",
    "json_body", "data_source", "_loaded_at",
]
TEXT_NUMBER_COLUMNS = ["time_on_site_seconds", "price_comparison_time"]
HIGH_CARDINALITY = 20

TARGET = "will_default"
LEAKAGE_COLUMNS = ["days_to_first_missed_payment"]

# Columns that are standardised before linear models; the rest pass through.
SCALED_FEATURES = [
    "amount", "risk_score", "payment_credit_limit", "price_comparison_time",
    "customer_tenure_days",
]

# Order of the reported risk levels.
RISK_LEVEL_ORDER = ["low", "medium", "high", "very_high"]

# Business constants.
RULE_DISCRIMINATION = 2.8
TARGET_DISCRIMINATION = 4.0
TARGET_PRECISION = 0.40
AVERAGE_AMOUNT = 144.0
DOWN_PAYMENT_RATE = 0.25
CHURN_RATE = 0.15
RANKING_WEIGHTS = {
    "recall_at_95_precision": 0.35,
    "auc_pr": 0.25,
    "max_business_value": 0.25,
    "recall_at_90_precision": 0.15,
}

# Feature families: the first rule with a matching fragment wins.
FEATURE_FAMILIES = [
    ("Customer Demographics",
     ["customer_credit_score", "customer_age", "customer_income", "customer_verification"]),
    ("Device/Technology", ["device_type", "device_is_trusted"]),
    ("Payment Context", ["payment_provider", "payment_credit_limit"]),
    ("Product Features", ["product_category", "product_risk"]),
    ("Purchase Behavior", ["purchase_context", "price_comparison"]),
    ("Risk Assessment", ["risk_score", "risk_scenario", "risk_level"]),
    ("Temporal Features",
     ["is_weekend", "is_month_end", "is_holiday", "is_business", "is_late", "time_of_day",
      "week_of_month"]),
]
EXACT_FAMILY = ("Transaction Details", ["amount", "installment_count", "customer_tenure_days"])
OTHER_FAMILY = "Other"

# Middle of each income bracket; our own choice, used for the amount-to-income ratio.
INCOME_MIDPOINTS = {
    "<25k": 12500.0, "25k-50k": 37500.0, "50k-75k": 62500.0, "75k-100k": 87500.0,
    "100k+": 125000.0,
}
