"""Explicit schemas and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, INT, BOOL, STAMP = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
CONFIDENCE = T.DecimalType(5, 4)

# Job types, job states, sentiments, sort orders, defaults of a crawl and of a label job.
JOB_TYPES = ("scrape_reviews", "label_reviews", "process_results", "cleanup_data", "export_data")
JOB_STATES = ("waiting", "active", "completed", "failed", "delayed")
SENTIMENTS = ("positive", "neutral", "negative")
SORT_METHODS = ("recent", "helpful")
DEFAULT_COUNTRIES = ("us",)
DEFAULT_PAGES = 5
MAX_PAGES = 10
DEFAULT_THROTTLE_MS = 500
DEFAULT_BATCH_SIZE = 20
DEFAULT_PAYLOAD_MODEL = "gpt-4.1-mini"
DEFAULT_LABEL_MODEL = "gpt-4o-mini"
DEFAULT_PRIORITY, DEFAULT_ATTEMPTS, DEFAULT_DELAY = 5, 3, 0
FALLBACK_THEME = "General Feedback"
UNKNOWN_THEME = "Unknown Theme"
UNKNOWN_APP = "Unknown App"

# Column titles of the review CSV, in order.
REVIEW_CSV_HEADERS = (
    ("id", "Review ID"),
    ("country", "Country"),
    ("user_name", "User Name"),
    ("user_url", "User URL"),
    ("version", "App Version"),
    ("score", "Rating"),
    ("title", "Review Title"),
    ("text", "Review Text"),
    ("url", "Review URL"),
    ("date", "Review Date"),
    ("reply_date", "Developer Reply Date"),
    ("reply_text", "Developer Reply Text"),
    ("helpful_votes", "Helpful Votes"),
)

# The taxonomy used when none can be read.
DEFAULT_TAXONOMY = {
    "themes": [
        {"name": "UI/UX Design", "description": "User interface and experience issues"},
        {"name": "Performance", "description": "App speed, crashes, loading issues"},
        {"name": "Features", "description": "App functionality and capabilities"},
        {"name": "Bugs/Errors", "description": "Technical issues and bugs"},
        {"name": "Authentication", "description": "Login, signup, account issues"},
        {"name": "Data/Sync", "description": "Data synchronization and storage"},
        {"name": "Pricing", "description": "Cost, billing, subscription issues"},
        {"name": "Customer Support", "description": "Help, support, documentation"},
        {"name": "General Feedback", "description": "General comments and feedback"},
    ]
}

RAW_REVIEW = _struct(
    id=STRING, userName=STRING, userUrl=STRING, version=STRING, score=INT, title=STRING, text=STRING,
    url=STRING, date=STRING, replyDate=STRING, replyText=STRING, helpfulVotes=INT,
)
REVIEW_PAGE = _struct(
    appId=STRING, appOrd=T.LongType(), sortMethod=STRING, sortOrd=INT, country=STRING, countryOrd=INT, page=INT,
    reviews=T.ArrayType(RAW_REVIEW), error=STRING,
)
APPS = _struct(
    id=STRING, title=STRING, description=STRING, version=STRING, developer=STRING, category=STRING,
    created_at=STAMP, updated_at=STAMP,
)
REVIEWS = _struct(
    id=STRING, app_id=STRING, user_name=STRING, user_url=STRING, version=STRING, score=INT, title=STRING,
    text=STRING, url=STRING, date=STAMP, reply_date=STAMP, reply_text=STRING, helpful_votes=INT, country=STRING,
    created_at=STAMP, updated_at=STAMP,
)
LABELS = _struct(
    id=STRING, review_id=STRING, theme=STRING, sentiment=STRING, severity=INT, feature_request=BOOL,
    direct_quote=STRING, confidence=CONFIDENCE, model_version=STRING, created_at=STAMP, updated_at=STAMP,
)
JOBS = _struct(
    id=STRING, type=STRING, status=STRING, payload=STRING, result=STRING, error_message=STRING, attempts=INT,
    max_attempts=INT, created_at=STAMP, updated_at=STAMP, processed_at=STAMP,
)
DEAD_LETTERS = _struct(
    id=STRING, original_job_data=STRING, original_job_id=STRING, original_job_type=STRING, failure_reason=STRING,
    failure_stack=STRING, failed_at=STAMP, attempts_made=INT, processed_on=STAMP, finished_on=STAMP, status=STRING,
)
TABLES = {"apps": APPS, "reviews": REVIEWS, "labels": LABELS, "jobs": JOBS, "dead_letters": DEAD_LETTERS}


def job_type_dimension(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({ord_}, '{name}')" for ord_, name in enumerate(JOB_TYPES))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(type_ord, type)")
