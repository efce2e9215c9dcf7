"""Review, label, job and log tables derived from the given tables, always from all of their rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators.crawl import dedup_reviews
from echolens.operators.deadletter import to_dead_letters
from echolens.operators.normalize import normalize_reviews

AS_OF = datetime(2024, 3, 1)
LATER = datetime(2024, 4, 1)
LATEST = datetime(2024, 5, 1)
c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def review_id(doc_id: Column) -> Column:
    return F.concat(F.lit("r"), doc_id.cast("string"))


def hours_from_2024(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + n * 3600)


def appearances(documents: DataFrame) -> DataFrame:
    """One raw review row per (review, sort, country) it was found under."""
    sorts = F.when(c("doc_id") % 3 == 0, F.array(F.lit("recent"), F.lit("helpful"))).otherwise(F.array(F.lit("recent")))
    english = F.when(c("doc_id") % 4 == 0, F.array(F.lit("us"), F.lit("gb"))).otherwise(F.array(F.lit("us")))
    countries = F.when(c("lang") == "en", english).otherwise(F.array(c("lang")))
    places = F.create_map(*[F.lit(v) for pair in enumerate(("us", "gb", "fr", "de", "es")) for v in pair[::-1]])
    return (
        documents
        .select("doc_id", "text", "source", F.explode(countries).alias("country_code"), sorts.alias("sorts"))
        .select("doc_id", "text", "source", "country_code", F.posexplode("sorts").alias("sort_ord", "sort_method"))
        .select(
            review_id(c("doc_id")).alias("id"),
            c("source").alias("app_id"),
            F.regexp_extract("source", r"([0-9]+)$", 1).cast("bigint").alias("app_ord"),
            "country_code",
            "sort_method",
            "sort_ord",
            F.coalesce(places[c("country_code")], F.lit(5)).alias("country_ord"),
            (c("doc_id") % 10 + 1).cast("int").alias("page"),
            c("doc_id").alias("pos"),
            F.when(c("doc_id") % 11 == 0, None)
            .when(c("doc_id") % 13 == 0, "")
            .otherwise(F.concat(F.lit("user"), (c("doc_id") % 97).cast("string")))
            .alias("user_name"),
            F.when(c("doc_id") % 7 != 0, F.concat(F.lit("1."), (c("doc_id") % 5).cast("string"))).alias("version"),
            (c("doc_id") % 5 + 1).cast("int").alias("score"),
            F.substring("text", 1, 40).alias("title"),
            "text",
            hours_from_2024(c("doc_id")).alias("date"),
            F.when(c("doc_id") % 19 != 0, (c("doc_id") % 17 + c("sort_ord")).cast("int")).alias("helpful_votes"),
        )
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearances(table(spark, sf_dir, "documents"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records with their reviews: ten documents to a page, ten pages to an app, per language."""
    votes = (c("doc_id") % 17).cast("int")
    review = F.struct(
        review_id(c("doc_id")).alias("id"),
        F.when(c("doc_id") % 13 == 0, "").otherwise(F.concat(F.lit("user"), (c("doc_id") % 97).cast("string"))).alias("user_name"),
        F.lit(None).cast("string").alias("user_url"),
        F.lit(None).cast("string").alias("version"),
        F.when(c("doc_id") % 12 != 11, (c("doc_id") % 6).cast("int")).alias("score"),
        F.substring("text", 1, 40).alias("title"),
        c("text"),
        F.when(c("doc_id") % 7 == 0, "not a url").alias("url"),
        F.date_format(hours_from_2024(c("doc_id")), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        F.lit(None).cast("string").alias("reply_date"),
        F.lit(None).cast("string").alias("reply_text"),
        votes.alias("helpful_votes"),
    )
    pages = (
        table(spark, sf_dir, "documents")
        .withColumns({"block": F.floor(c("doc_id") / 100), "page": (F.floor(c("doc_id") / 10) % 10 + 1).cast("int")})
        .groupBy("block", "lang", "page")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", review.alias("r")))).alias("found"))
    )
    return pages.select(
        F.concat(F.lit("app"), c("block").cast("string")).alias("app_id"),
        c("block").alias("app_ord"),
        F.lit("recent").alias("sort_method"),
        F.lit(0).alias("sort_ord"),
        c("lang").alias("country_code"),
        F.lit(0).alias("country_ord"),
        "page",
        c("found.r").alias("reviews"),
        F.when((c("page") == 9) & (c("block") % 3 == 0), "timeout").alias("error"),
        F.size("found").alias("n_reviews"),
    )


def stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review table: normalised, one row per id. Creation times repeat, so ordering needs the id as well."""
    day = hours_from_2024(F.floor(c("pos") / 24) * 24)
    unique = dedup_reviews(normalize_reviews(raw_reviews(spark, sf_dir)))
    return unique.withColumns({"created_at": day, "updated_at": day}).select(*S.REVIEWS.fieldNames())


def analysis_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as analysis columns: missing themes, unknown sentiments and missing severities included."""
    bad = (c("toxic") == 1) | (c("quality") == 0)
    theme = F.concat(F.lit("theme_"), F.when(bad, c("doc_id") % 5).otherwise(c("doc_id") % 15).cast("string"))
    return table(spark, sf_dir, "labels").select(
        review_id(c("doc_id")).alias("review_id"),
        c("doc_id").alias("ord"),
        F.when(c("doc_id") % 29 != 0, theme).alias("theme"),
        F.when(c("doc_id") % 31 == 0, "mixed")
        .when(bad, "negative")
        .when(c("doc_id") % 9 == 0, "neutral")
        .otherwise("positive")
        .alias("sentiment"),
        F.when(c("doc_id") % 23 != 0, ((c("doc_id") * 7) % 5 + 1).cast("int")).alias("severity"),
        F.when(c("doc_id") % 6 == 0, "Y").otherwise("N").alias("feature_request"),
        (((c("doc_id") * 37) % 101).cast("double") / 100).alias("confidence"),
        F.lit("").alias("direct_quote"),
    )


def analysis_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON records; every 17th record has no analysis object."""
    fields = F.struct("theme", "sentiment", "severity", "feature_request", "review_id")
    whole = F.to_json(F.struct(c("review_id").alias("id"), fields.alias("analysis")))
    broken = F.to_json(F.struct(c("review_id").alias("id"), F.lit("none").alias("analysis")))
    rows = analysis_columns(spark, sf_dir)
    return rows.select("ord", F.parse_json(F.when(c("ord") % 17 == 0, broken).otherwise(whole)).alias("record"))


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table with valid values."""
    stamp = F.lit(AS_OF).cast("timestamp")
    rows = analysis_columns(spark, sf_dir)
    return rows.select(
        F.concat(F.lit("L"), c("ord").cast("string")).alias("id"),
        "review_id",
        F.coalesce("theme", F.lit(S.FALLBACK_THEME)).alias("theme"),
        F.when(c("sentiment") == "mixed", "neutral").otherwise(c("sentiment")).alias("sentiment"),
        F.coalesce("severity", F.lit(1)).alias("severity"),
        (c("feature_request") == "Y").alias("feature_request"),
        F.concat(F.lit("quote "), c("ord").cast("string")).alias("direct_quote"),
        c("confidence").cast(S.CONFIDENCE).alias("confidence"),
        F.lit("m1").alias("model_version"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(table(spark, sf_dir, "events"))


def jobs_of(events: DataFrame) -> DataFrame:
    types = F.create_map(
        *[
            F.lit(v)
            for pair in {
                "click": "scrape_reviews", "view": "label_reviews", "purchase": "process_results",
                "signup": "cleanup_data",
            }.items()
            for v in pair
        ]
    )
    states = F.create_map(*[F.lit(v) for pair in enumerate(("failed", "waiting", "active", "delayed")) for v in pair])
    cycle = F.floor(c("event_id") / 20) % 3
    reason = F.when(cycle == 0, "Network timeout").when(cycle == 1, "Rate limit")
    return events.select(
        c("event_id").alias("id"),
        F.coalesce(types[c("event_type")], F.lit("export_data")).alias("type"),
        F.coalesce(states[(c("event_id") % 20).cast("int")], F.lit("completed")).alias("status"),
        c("ts").alias("created_at"),
        (cycle + 1).cast("int").alias("attempts"),
        F.when(c("event_id") % 20 == 0, reason).alias("error_message"),
    )


def job_states_of(events: DataFrame) -> DataFrame:
    """Four rows to a job, each with a state and a time of its own; the last event comes first in the course of some."""
    states = F.create_map(*[F.lit(v) for pair in enumerate(("waiting", "active", "completed", "failed", "delayed")) for v in pair])
    job = F.floor(c("event_id") / 4)
    return events.select(
        job.cast("string").alias("id"),
        F.when(job % 3 == 0, "scrape_reviews").when(job % 3 == 1, "label_reviews").otherwise("export_data").alias("type"),
        states[((c("event_id") * 7 + c("user_id")) % 5).cast("int")].alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + (c("event_id") * 13) % 4).alias("updated_at"),
    )


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = job_table(spark, sf_dir).where(c("status") == "failed")
    return to_dead_letters(failed, c("created_at"))


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows: a level, and a map with a sensitive member ``key`` besides harmless ones."""
    return table(spark, sf_dir, "events").select(
        c("event_id").alias("id"),
        F.when(c("event_type") == "view", "debug").when(c("event_type") == "error", "error").otherwise("info").alias("level"),
        F.create_map(
            F.lit("key"), c("props"),
            F.when(c("event_id") % 2 == 0, "token").otherwise("operation"), c("event_type"),
            F.lit("user"), c("user_id").cast("string"),
        ).alias("metadata"),
    )
