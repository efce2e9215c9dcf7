"""Normalisation of raw reviews, app records, analyses and model labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.coercion import (
    as_text,
    float_prefix,
    int_prefix,
    is_kind,
    is_truthy,
    member,
    number_or,
    text_or,
    truthy_text,
)

MODEL_NAMES = {
    "user_name": "userName",
    "user_url": "userUrl",
    "reply_date": "replyDate",
    "reply_text": "replyText",
    "helpful_votes": "helpfulVotes",
}
MODEL_COLUMNS = (
    "id", "user_name", "user_url", "version", "score", "title", "text", "url", "date", "reply_date", "reply_text",
    "helpful_votes", "country",
)
QUOTE_LENGTH = 100


def _timestamp(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.try_to_timestamp(text_or(F.col(name), None))
    return F.col(name)


def normalize_reviews(raw: DataFrame) -> DataFrame:
    """Fill defaults, parse dates and stamp the crawl country over whatever the record says.

    ``raw`` has the snake_case review columns and ``country_code``; other columns, such as the crawl ordinals,
    pass through. A date that does not parse becomes NULL.
    """
    present = set(raw.columns)

    def text(name: str, default: str | None) -> Column:
        return text_or(F.col(name), default) if name in present else F.lit(default).cast("string")

    def stamp(name: str) -> Column:
        return _timestamp(raw, name) if name in present else F.lit(None).cast("timestamp")

    votes = number_or(F.col("helpful_votes").cast("double"), 0) if "helpful_votes" in present else F.lit(0)
    return raw.withColumns(
        {
            "user_name": text("user_name", "Anonymous"),
            "user_url": text("user_url", None),
            "version": text("version", "Unknown"),
            "title": text("title", ""),
            "text": text("text", ""),
            "url": text("url", None),
            "date": stamp("date"),
            "reply_date": stamp("reply_date"),
            "reply_text": text("reply_text", None),
            "helpful_votes": votes.cast("int"),
            "country": F.upper("country_code"),
        }
    ).drop("country_code")


def normalize_apps(wanted_ids: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per wanted app id. An app that could not be fetched keeps its id and the default title."""
    found = fetched.select(
        "id",
        text_or(F.col("title"), S.UNKNOWN_APP).alias("title"),
        *[text_or(F.col(name), None).alias(name) for name in ("description", "version", "developer")],
        text_or(F.col("genre"), None).alias("category"),
    )
    return (
        wanted_ids.select("id")
        .join(found, "id", "left")
        .withColumn("title", F.coalesce("title", F.lit(S.UNKNOWN_APP)))
    )


def to_model_columns(reviews: DataFrame) -> DataFrame:
    """The 13 stored review columns under their model names."""
    return reviews.select(*MODEL_COLUMNS).withColumnsRenamed(MODEL_NAMES)


def labels_to_analyses(labels: DataFrame) -> DataFrame:
    """Label records (boolean feature request) as normalised analysis records ('Y'/'N')."""
    return labels.withColumn("feature_request", F.when(F.col("feature_request"), "Y").otherwise("N"))


def normalize_analyses(analyses: DataFrame) -> DataFrame:
    """Typed analysis rows from (ord, record variant), with a ``skipped`` flag.

    A record is skipped when it is falsy or its ``analysis`` is not an object; an array counts as an object.
    """
    analysis = F.col("_analysis")
    severity = member(analysis, "severity")
    return (
        analyses.withColumn("_analysis", member(F.col("record"), "analysis"))
        .select(
            "ord",
            (~is_kind(analysis, "object", "array")).alias("skipped"),
            truthy_text(member(analysis, "theme"), S.UNKNOWN_THEME).alias("theme"),
            truthy_text(member(analysis, "sentiment"), "neutral").alias("sentiment"),
            F.when(is_kind(severity, "number"), F.try_variant_get(severity, "$", "double"))
            .otherwise(F.lit(1.0))
            .alias("severity"),
            F.when(
                is_kind(member(analysis, "feature_request"), "string")
                & (as_text(member(analysis, "feature_request")) == "Y"),
                "Y",
            )
            .otherwise("N")
            .alias("feature_request"),
            truthy_text(member(analysis, "direct_quote"), "").alias("direct_quote"),
            as_text(member(analysis, "review_id")).alias("review_id"),
        )
    )


def analyses_from_columns(rows: DataFrame, *others: str) -> DataFrame:
    """The same defaults for analyses that are already typed columns, such as a stored label table.

    ``others`` are columns that pass through.
    """
    return rows.select(
        *others,
        "ord",
        F.lit(False).alias("skipped"),
        text_or(F.col("theme"), S.UNKNOWN_THEME).alias("theme"),
        text_or(F.col("sentiment"), "neutral").alias("sentiment"),
        F.coalesce(F.col("severity").cast("double"), F.lit(1.0)).alias("severity"),
        F.when(F.col("feature_request") == "Y", "Y").otherwise("N").alias("feature_request"),
        F.coalesce(F.col("direct_quote"), F.lit("")).alias("direct_quote"),
        "review_id",
    )


LABEL_MEMBERS = ("reviewId", "theme", "sentiment", "severity", "featureRequest", "directQuote", "confidence")


def _label_columns(model: str) -> list[Column]:
    """The cleaned label from the columns ``_m_<member>``."""

    def m(name: str) -> Column:
        return F.col(f"_m_{name}")

    sentiment = F.when(is_kind(m("sentiment"), "string"), as_text(m("sentiment")))
    severity = number_or(F.coalesce(int_prefix(as_text(m("severity"))), F.lit(0.0)), 1.0)
    confidence = number_or(F.coalesce(float_prefix(as_text(m("confidence"))), F.lit(0.0)), 0.5)
    return [
        truthy_text(m("reviewId"), "").alias("review_id"),
        truthy_text(m("theme"), S.FALLBACK_THEME).alias("theme"),
        F.when(sentiment.isin(*S.SENTIMENTS), sentiment).otherwise("neutral").alias("sentiment"),
        F.greatest(F.lit(1.0), F.least(F.lit(5.0), severity)).cast("int").alias("severity"),
        is_truthy(m("featureRequest")).alias("feature_request"),
        F.substring(truthy_text(m("directQuote"), ""), 1, QUOTE_LENGTH).alias("direct_quote"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).cast(S.CONFIDENCE).alias("confidence"),
        F.lit(model).alias("model_version"),
    ]


def breaks_batch(element: Column) -> Column:
    """True for an element that fails its whole batch: null, or a truthy quote that is not sliceable."""
    quote = member(element, "directQuote")
    return element.isNull() | is_kind(element, "null") | (
        is_truthy(quote) & ~is_kind(quote, "string", "array")
    )


def clean_labels(elements: DataFrame, model: str = S.DEFAULT_LABEL_MODEL) -> DataFrame:
    """Cleaned labels from a table with an ``element`` variant column; other columns pass through.

    Every member is taken out once, as a column of its own.
    """
    others = [name for name in elements.columns if name != "element"]
    members = [member(F.col("element"), name).alias(f"_m_{name}") for name in LABEL_MEMBERS]
    return elements.select(*others, *members).select(*others, *_label_columns(model))


def restrict_to_taxonomy(labels: DataFrame, theme_names: list[str]) -> DataFrame:
    """Optional strict mode: a theme outside the taxonomy becomes general feedback."""
    known = F.col("theme").isin(*theme_names)
    return labels.withColumn("theme", F.when(known, F.col("theme")).otherwise(S.FALLBACK_THEME))
