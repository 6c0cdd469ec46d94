"""Fixed values.

Every list and number in this module must equal the behaviour being matched
(word lists, thresholds, name patterns, month multipliers). They are kept
here, plainly and in their natural order, so that operators share one copy.
"""

# ---- fixed values: thresholds ------------------------------------------------
MAX_DIMENSION_CARDINALITY = 50
NUMBER_SHARE = 0.90
DATE_SHARE = 0.70
DATE_SHARE_NAMED = 0.50
PERCENT_SHARE = 0.5          # strictly greater than
HIGH_NULL_SHARE = 0.9        # strictly greater than
ANOMALY_MIN_ROWS = 5
ANOMALY_Z = 1.75
TREND_MIN_ROWS = 3
CLUSTER_MIN_ROWS = 12
CLUSTER_MIN_NUMERIC = 2
LINE_COLLAPSE_ROWS = 50
EXPORT_CAP = 50000
PREVIEW_ROWS = 200
CHART_SAMPLE_ROWS = 20
SLUG_MAX = 50
SLUG_DEFAULT = "analysis"
GENERATION_RETRIES = 2

# ---- fixed values: names and patterns ----------------------------------------
ID_NAME_PATTERN = (
    r"(_id|_key|_pk|_fk|_code|_num|_no|_number|_ref|_uuid|_sku|_hash)$"
    r"|^(id|key|pk|fk|uuid|sku)$"
    r"|(phone|postal|zip|fax|barcode|isbn|ssn|ein|tin|vat|npi)"
)
DATE_NAME_PATTERN = (
    r"(date|time|_dt|_at|_ts|timestamp|created|updated|modified|"
    r"ordered|shipped|delivered|day|month|year|period|week)"
)
CURRENCY_CLASS = r"[$€£¥₹₩₪₦₫฿﷼,]"
PERCENT_SUFFIX = r"\s*%\s*$"
PERCENT_DETECT = r"%\s*$"

# Cleaning NA spellings, compared after trim and lower-casing.
NA_STRINGS = ["nan", "none", "null", "na", "n/a", "nil", "#n/a", "#na", "-", "--", ""]
# Spellings a delimited-file reader treats as missing at read time (exact case).
READER_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                     "nan", "null"]
READER_TRUE = ["True", "TRUE", "true"]
READER_FALSE = ["False", "FALSE", "false"]

SQL_RESERVED_NAMES = [
    "select", "from", "where", "group", "order", "by", "having", "join", "on",
    "as", "with", "table", "index", "key", "primary", "foreign", "references",
    "default", "not", "null", "and", "or", "in", "is", "like", "between", "case",
    "when", "then", "else", "end", "distinct", "count", "sum", "avg", "min",
    "max", "create", "drop", "alter", "insert", "update", "delete", "into",
    "values", "set", "limit", "offset", "union", "all", "exists", "unique",
    "check", "constraint", "column",
]

DELIMITERS = [",", "\t", ";", "|"]

# ---- fixed values: question rules --------------------------------------------
SUMMARY_TRIGGERS = [
    "summarize", "summary", "explain the", "explain why", "explain how",
    "describe the", "describe what", "tell me about", "interpret",
    "give me a summary", "give me an overview", "break it down",
    "in plain english", "what does this mean", "what does that mean",
]

# intent -> words; the first intent with a match wins, else "summary"
INTENT_WORDS = [
    ("anomaly", ["anomaly", "outlier", "unusual", "spike", "drop", "weird"]),
    ("trend", ["trend", "monthly", "quarter", "over time", "by month", "per month"]),
    ("segmentation", ["segment", "cluster", "group of customers", "customer type"]),
    ("comparison", ["compare", " vs ", "versus", "difference between"]),
]
INTENT_DEFAULT = "summary"

# template routes, first wins, else "generic"
TEMPLATE_TREND_WORDS = ["monthly", "trend", "over time", "by month", "per month"]
TEMPLATE_SEGMENT_WORDS = ["segment", "customer", "cluster", "group"]

GLOSSARY = [
    ("sales", "Use total_amount, revenue, or net_amount columns for sales aggregations."),
    ("revenue", "Revenue is typically total_amount or net_amount — check column names in schema."),
    ("returns", "Look for return_amount, return_count, or tables with 'return' in the name."),
    ("top products", "Group by product_name or category, order by revenue or quantity DESC."),
    ("customer segment", "Group by segment, loyalty_tier, or customer_type columns."),
    ("region", "Group by region, region_name, or city columns."),
    ("channel", "Group by channel, channel_name, or source columns."),
    ("trend", "Join or group by date, month, year columns and order chronologically."),
]

TABLE_KEYWORDS = [
    ("sale", ["fact_orders", "fact_order_items", "dim_date"]),
    ("revenue", ["fact_orders", "fact_order_items", "dim_date"]),
    ("product", ["dim_product", "fact_order_items", "fact_orders"]),
    ("return", ["fact_returns", "fact_order_items", "fact_orders", "dim_region"]),
    ("region", ["dim_region", "fact_orders", "fact_returns"]),
    ("customer", ["dim_customer", "fact_orders", "fact_returns"]),
    ("segment", ["dim_customer", "fact_orders"]),
    ("channel", ["dim_channel", "fact_orders"]),
    ("trend", ["dim_date", "fact_orders"]),
    ("month", ["dim_date", "fact_orders"]),
]

UNSAFE_KEYWORDS = ["insert", "update", "delete", "drop", "alter", "create",
                   "grant", "truncate", "merge"]
UNSAFE_FUNCTIONS = ["pg_sleep", "dblink", "copy"]

# ---- fixed values: column-choice hints ---------------------------------------
METRIC_HINTS = ["revenue", "total", "amount", "sales", "price", "income", "value",
                "cost", "profit", "turnover"]
DATE_HINTS = ["date", "time", "month", "year", "day", "week", "period"]
DIMENSION_HINTS = ["category", "product", "region", "segment", "channel", "type",
                   "status", "brand", "dept", "city", "state", "country", "gender",
                   "payment"]
ID_HINTS = ["_id", "_key", "uuid", "sku"]
FLOAT_TYPE_HINTS = ["real", "float", "numeric", "double", "decimal"]

METRIC_TIERS = [
    ["revenue", "sales", "total_amount", "net_amount", "gross_income", "gross_profit"],
    ["total", "amount", "profit", "income", "turnover", "value", "cost"],
    ["price", "quantity", "gross", "tax"],
]
DIMENSION_TIERS = [
    ["category", "product_line", "product", "region", "segment", "department"],
    ["type", "status", "brand", "channel", "payment", "line"],
    ["city", "state", "country", "gender", "branch"],
]

# ---- fixed values: seeder data rules -----------------------------------------
MONTH_MULTIPLIERS = [0.92, 0.96, 1.0, 1.02, 1.03, 1.04, 1.1, 1.02, 0.98, 1.05, 1.2, 1.28]
AGE_BAND_EDGES = [(25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54")]
AGE_BAND_LAST = "55+"
DISCOUNT_CAP = 0.35
ELECTRONICS_HOLIDAY_BONUS = 0.08
SOCIAL_BONUS = 0.05
TAX_RATE = 0.075
RETURN_BASE = 0.045
RETURN_APPAREL = 0.05
RETURN_WEST = 0.01
RETURN_JANUARY = 0.03
RETURN_AMOUNT_FACTOR = 0.92

# ---- fixed values: message texts ----------------------------------------------
CLUSTER_MESSAGE = ("This result has enough numeric density to support customer or region "
                   "clustering in a follow-up analysis.")
EMPTY_MESSAGE = ("The query completed successfully, but there were no matching records "
                 "in the warehouse.")
