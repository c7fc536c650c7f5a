"""The data contract: column names, texts and thresholds that results depend on."""

# --- Fixed values -----------------------------------------------------------
# Training table.
ID_COLUMNS = ["RowNumber", "CustomerId", "Surname"]
TARGET = "Exited"

# Model inputs; numeric first, then categorical. This order is also the order
# of the columns in the model matrix.
NUMERIC_FEATURES = [
    "CreditScore",
    "Age",
    "Tenure",
    "Balance",
    "NumOfProducts",
    "HasCrCard",
    "IsActiveMember",
    "EstimatedSalary",
]
CATEGORICAL_FEATURES = ["Geography", "Gender"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

# Fields a scoring record must carry, in the order errors are reported.
REQUIRED_FIELDS = [
    "CreditScore",
    "Geography",
    "Gender",
    "Age",
    "Tenure",
    "Balance",
    "NumOfProducts",
    "HasCrCard",
    "IsActiveMember",
    "EstimatedSalary",
]

# Cells that count as missing in an uploaded CSV (the defaults of pandas.read_csv).
CSV_MISSING = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

BATCH_MODES = ("fail_fast", "partial")

# Decisions: probability limits, actions and what an action costs.
LOW_RISK = 0.30
HIGH_RISK = 0.60
NO_ACTION = "No action"
SEND_EMAIL = "Retention email"
OFFER_CALL = "Discount or retention call"
ACTION_COSTS = {NO_ACTION: 0.0, SEND_EMAIL: 5.0, OFFER_CALL: 50.0}

# Model choice and evaluation.
MODEL_ORDER = [
    "Logistic Regression",
    "Decision Tree",
    "Random Forest",
    "Gradient Boosting",
]
MIN_ROC_AUC = 0.6
LIFT_FRACTIONS = [0.01, 0.05, 0.1, 0.2, 0.3]
LABEL_THRESHOLD = 0.5
DEFAULT_MODEL_NAME = "churn_predictor"
DEFAULT_MODEL_VERSION = "1.0.0"

# Outreach defaults. The request job and the batch job differ in their threshold.
REQUEST_THRESHOLD = 0.65
BATCH_THRESHOLD = 0.7
MAX_EMAILS = 50
TONES = ["serious", "witty", "concise"]
CONTRACT_VERSION = "v1"
FROM_EMAIL = "no-reply@example.com"
TONE_POLICY = "friendly-and-direct"
SEND_MODE = "dry_run"
SENT_STATUSES = ["sent", "queued", "accepted", "ok", "success"]
BATCH_STATUSES = ["success", "partial", "failed", "error"]
CANDIDATE_OPTION_KEYS = [
    "email_candidate_rules",
    "email_selection",
    "candidate_selection",
    "email_candidates",
]
BATCH_PROMPT = (
    "Write a retention outreach email from {from_name} at {company_name} "
    "for {recipient_count} recipients: {recipient_ids}."
)
PROBABILITY_COLUMNS = ["p_churn", "churn_probability", "probability"]
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
TAG_PATTERN = r"<[^>]+>"
NOT_AN_OBJECT = "Record must be a JSON object"
EMPTY_BODY = "Request body is empty"
BROKEN_BODY = "Request body must be valid JSON"
NO_RECORDS = "Request body has no list of records"
LONG_LINE = "CSV line has more cells than columns"
OPEN_QUOTE = "CSV has a quoted cell that never ends"
OTHER_HEADER = "CSV files differ in their header"
NO_EMAIL_SKIPPED = "Skipping recipient without email"
NO_RECIPIENTS_LEFT = "No recipients with valid email addresses remain after payload normalization"
BAD_BATCH_STATUS = "'batch_response.status' is missing or unsupported"
NO_MAPPING = "'{name}' must be a dictionary when provided"
WRITER_ERRORS = "Sales manager returned errors"
NO_ADDRESS = "Selected row is missing a valid 'email'"
INDEX_OUT_OF_RANGE = "Result index is out of range and row was skipped"
INDEX_INVALID = "Result index is invalid and row was skipped"
# --- End of fixed values ------------------------------------------------------
