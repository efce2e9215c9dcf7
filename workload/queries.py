"""One query per operator. Each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.offline import KeywordLabeler
from echolens.functions.text import iso_millis, sanitize_name
from echolens.operators import (
    backlog,
    crawl,
    deadletter,
    insights,
    jobs,
    labeling,
    merge,
    normalize,
    ops,
    query,
    validate,
)
from echolens.plans import maintain, retry
from echolens.plans.collect import check_reviews, collect_reviews, reviews_to_store
from echolens.plans.label import label_backlog
from echolens.plans.report import insight_report
from echolens.session import shared_folder
from echolens.sources import readers, writers
from echolens.sources.versions import Versions
from echolens.streaming import jobs as job_streams
from echolens.streaming import reviews as review_streams
from workload import inputs as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col

# The keyword rules for the synthetic texts: syllables that occur in them.
LABELER = KeywordLabeler(
    themes={"Performance": ("tionre",), "Pricing": ("ingen", "ungen"), "Features": ("ciónes", "erle")},
    positive=("the", "les", "und"),
    negative=("er", "ou", "ent"),
    requests=("tha", "que"),
)
COUNTRIES, SORTS = ("us", "gb", "fr", "de", "es"), ("recent", "helpful")


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes, next to the checkpoints that every executor reaches."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _iso(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: iso_millis(c(name)) for name in names})


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(c("source").alias("app_id")).distinct()


def _fetched_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App records for the even-numbered sources; some lack a title or other parts."""
    n = F.regexp_extract("app_id", r"([0-9]+)$", 1).cast("int")
    return _apps(spark, sf_dir).where(n % 2 == 0).select(
        c("app_id").alias("id"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("App "), "app_id")).alias("title"),
        F.when(n % 4 != 0, F.concat(F.lit("About "), "app_id")).alias("description"),
        F.lit("1.0").alias("version"),
        F.lit("").alias("developer"),
        F.lit("Finance").alias("genre"),
    )


# --- insights ------------------------------------------------------------------------------------------------


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.analyses_from_columns(T.analysis_columns(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.insight_stats(_analyses(spark, sf_dir))


@register
def theme_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = insight_report(_analyses(spark, sf_dir))
    return insights.theme_flags(report.themes, report.totals).select(
        "theme", "mentions", "positive", "negative", "neutral", "requests", "average_severity", "is_significant",
        "is_strength", "is_weakness", "is_threat",
    )


@register
def overall_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.overall_sentiment(_stats(spark, sf_dir))


@register
def avg_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.theme_insights(_stats(spark, sf_dir)).select("theme", "severity_count", "average_severity")


@register
def feature_requests_by_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.feature_requests(_stats(spark, sf_dir))


@register
def feature_request_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.analysis_columns(spark, sf_dir).withColumn("direct_quote", F.concat(F.lit("quote of "), "review_id"))
    return insights.feature_request_quotes(normalize.analyses_from_columns(rows))


@register
def top_request_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.top_request_themes(insights.feature_requests(_stats(spark, sf_dir)))


@register
def insight_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = T.analysis_records(spark, sf_dir)
    return insights.insight_totals(insights.insight_stats(normalize.normalize_analyses(records)))


@register
def normalize_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_analyses(T.analysis_records(spark, sf_dir)).drop("direct_quote")


@register
def labels_to_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridged = normalize.labels_to_analyses(T.stored_labels(spark, sf_dir))
    return bridged.select("review_id", "theme", "sentiment", "severity", "feature_request", "direct_quote")


@register
def swot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight_report(_analyses(spark, sf_dir)).swot


@register
def swot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.swot_report(insight_report(_analyses(spark, sf_dir)).swot)


@register
def swot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.swot_json(insight_report(_analyses(spark, sf_dir)).swot)


@register
def insights_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The themes of the JSON object, with its totals beside each."""
    rows = T.analysis_columns(spark, sf_dir).withColumn("direct_quote", F.concat(F.lit("quote of "), "review_id"))
    analyses = normalize.analyses_from_columns(rows)
    report = insight_report(analyses)
    quotes = insights.feature_request_quotes(analyses)
    made = insights.insights_json(report.themes, report.overall, report.totals, quotes)
    schema = (
        "totalReviews long, themes map<string, struct<count: long, positive: long, negative: long, neutral: long, averageSeverity: double>>,"
        " featureRequests struct<count: long, themes: map<string, long>, quotes: array<struct<theme: string, quote: string, review_id: string>>>,"
        " overallSentiment struct<positive: long, negative: long, neutral: long>, skippedReviews long"
    )
    read = made.select(F.from_json("insights", schema).alias("i")).select("i.*")
    return read.select("*", F.explode("themes").alias("theme", "t")).select(
        "theme", "t.*", F.coalesce(c("featureRequests.themes")[c("theme")], F.lit(0)).alias("requests"),
        c("totalReviews").alias("total"), c("skippedReviews").alias("skipped"), c("overallSentiment.positive").alias("all_positive"),
        F.size("featureRequests.quotes").alias("quotes"), c("featureRequests.quotes")[0]["quote"].alias("first_quote"),
    )


@register
def avg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.average_confidence(T.stored_labels(spark, sf_dir), ["theme"])


@register
def sentiment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.sentiment_breakdown(T.stored_labels(spark, sf_dir), ["theme"])


# --- collect -------------------------------------------------------------------------------------------------


@register
def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = crawl.crawl_jobs(_apps(spark, sf_dir))
    return planned.withColumns(
        {"countries": F.array_join("countries", ","), "sort_methods": F.array_join("sort_methods", ",")}
    ).drop("correlation_id")


@register
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_plan(crawl.crawl_jobs(_apps(spark, sf_dir), COUNTRIES, 12, SORTS))


def _page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = T.raw_reviews(spark, sf_dir).groupBy("app_id", "country_code", "sort_method", "page").agg(
        F.count("*").alias("n_reviews")
    )
    return counted.withColumn("error", F.when((c("page") == 8) & (c("sort_method") == "helpful"), "timeout"))


@register
def crawl_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.apply_early_stop(_page_counts(spark, sf_dir)).drop("error")


@register
def collect_landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = reviews_to_store(collect_reviews(T.landed_pages(spark, sf_dir)).accepted)
    return _iso(stored, "date").select("id", "app_id", "user_name", "version", "score", "title", "text", "date", "helpful_votes", "country")


@register
def quarantine_landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = collect_reviews(T.landed_pages(spark, sf_dir)).quarantined
    return bad.select("id", "app_id", "score", F.array_join("errors", "; ").alias("errors"))


@register
def landed_pages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON and read back, then counted per page."""
    path = _scratch(spark, "pages")
    names = {new: old for old, new in readers.PAGE_NAMES.items()}
    T.landed_pages(spark, sf_dir).drop("n_reviews").withColumnsRenamed(names).write.json(path)
    pages = readers.read_review_pages(spark, path)
    return pages.select("app_id", "country_code", "page", "n_reviews", "error")


def _land(spark: SparkSession, sf_dir: str) -> str:
    """The landed pages as the JSON files a crawler writes, member names and all."""
    path = _scratch(spark, "landed")
    names, inner = ({new: old for old, new in known.items()} for known in (readers.PAGE_NAMES, readers.RAW_NAMES))
    pages = T.landed_pages(spark, sf_dir).drop("n_reviews")
    members = pages.schema["reviews"].dataType.elementType.fieldNames()
    written = F.transform("reviews", lambda r: F.struct(*[r[m].alias(inner.get(m, m)) for m in members]))
    pages.withColumn("reviews", written).withColumnsRenamed(names).write.json(path)
    return path


@register
def landed_page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of every review of the landed files."""
    rows = readers.explode_pages(readers.read_review_pages(spark, _land(spark, sf_dir)))
    return rows.select(
        "app_id", "country_code", "page", "pos", "id", "user_name", "score", "title", "text", "url", "helpful_votes"
    )


@register
def early_stop_long_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per source with a page for every twenty documents; most have gaps, some are long."""
    pages = T.table(spark, sf_dir, "documents").groupBy(
        c("source").alias("app_id"), F.lit("us").alias("country_code"), F.lit("recent").alias("sort_method"),
        (F.floor(c("doc_id") / 20) + 1).alias("page"),
    ).agg(F.count("*").alias("n_reviews"), F.lit(None).cast("string").alias("error"))
    return crawl.apply_early_stop(pages).select("app_id", "page")


@register
def dedup_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.dedup_reviews(T.raw_reviews(spark, sf_dir)).select(
        "id", "app_id", "country_code", "sort_method", "page", "pos", "score", "title", "text", "helpful_votes",
        "first_seen_sort_ord", "first_seen_country_ord",
    )


@register
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = crawl.crawl_plan(crawl.crawl_jobs(_apps(spark, sf_dir), COUNTRIES, 10, SORTS))
    return crawl.crawl_summary(T.stored_reviews(spark, sf_dir), plan, _fetched_apps(spark, sf_dir))


@register
def crawl_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one crawl job per app; every third one failed."""
    n = F.regexp_extract("app_id", r"([0-9]+)$", 1).cast("int")
    started = F.lit(T.AS_OF).cast("timestamp")
    runs = _apps(spark, sf_dir).select(
        "app_id", started.alias("started_at"), F.timestamp_millis(F.unix_millis(started) + n * 250).alias("finished_at"),
        F.when(n % 3 == 0, F.concat(F.lit("timeout of "), "app_id")).alias("error"),
    )
    return crawl.crawl_results(crawl_summary(spark, sf_dir), runs)


@register
def normalize_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize_reviews(T.raw_reviews(spark, sf_dir))
    return _iso(rows, "date").select("id", "sort_ord", "user_name", "version", "score", "title", "text", "helpful_votes", "country", "date")


@register
def normalize_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _apps(spark, sf_dir).select(c("app_id").alias("id"))
    return normalize.normalize_apps(wanted, _fetched_apps(spark, sf_dir))


@register
def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.to_model_columns(T.stored_reviews(spark, sf_dir))
    return _iso(rows, "date").drop("userUrl", "url", "replyDate", "replyText")


@register
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(
        "doc_id",
        sanitize_name(c("text")).alias("name"),
        sanitize_name(F.concat(F.lit("  "), c("text"), F.lit(' "x" ')), legacy=True).alias("legacy_name"),
    )


def _flawed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reviews with defects that follow from the position in the table."""
    n = F.substring("id", 2, 20).cast("bigint")
    return T.stored_reviews(spark, sf_dir).withColumns(
        {
            "score": F.when(n % 14 == 3, 6).otherwise(c("score")),
            "url": F.when(n % 15 == 4, "not a url").when(n % 3 == 0, F.concat(F.lit("https://example.com/"), "id")),
            "helpful_votes": F.when(n % 16 == 5, -1).when(n % 16 == 6, None).otherwise(c("helpful_votes")),
            "country": F.when(n % 18 == 7, "usa").otherwise(F.lower("country")),
            "title": F.when(n % 20 == 8, None).otherwise(c("title")),
        }
    )


@register
def validate_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = validate.validate_reviews(_flawed_reviews(spark, sf_dir))
    good = ok.select("id", "country", "helpful_votes", F.lit("").alias("errors"))
    return good.unionByName(bad.select("id", "country", "helpful_votes", F.array_join("errors", "; ").alias("errors")))


@register
def stored_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of three tables, of which some break a constraint; broken rows with their codes."""
    n = F.substring("id", 2, 20).cast("bigint")
    labels = T.stored_labels(spark, sf_dir).withColumns(
        {
            "id": F.concat(F.lit("L"), F.when(n % 25 == 1, n - 1).otherwise(n).cast("string")),
            "confidence": F.when(n % 12 == 2, 1.5).otherwise(c("confidence")).cast("double"),
        }
    )
    reviews = T.stored_reviews(spark, sf_dir).withColumns(
        {
            "id": F.when(n % 26 == 1, F.concat(F.lit("r"), (n - 1).cast("string"))).otherwise(c("id")),
            "app_id": F.when(n % 17 != 3, c("app_id")),
            "country": F.when(n % 19 != 4, c("country")),
            "score": F.when(n % 14 == 3, 6).otherwise(c("score")),
        }
    )
    k = F.regexp_extract("app_id", r"([0-9]+)$", 1).cast("int")
    apps = _apps(spark, sf_dir).select(
        F.when(k % 5 != 2, c("app_id")).alias("id"), F.when(k % 3 != 1, F.concat(F.lit("App "), "app_id")).alias("title")
    )
    found = []
    for name, rows in (("labels", labels), ("reviews", reviews), ("apps", apps)):
        _, bad = validate.check_stored(rows, name)
        found.append(bad.select(F.lit(name).alias("table_name"), "id", F.array_join("errors", "; ").alias("errors")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _payload_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with payloads of which some break a rule of their type."""
    n = c("id")
    ident = n.cast("string")
    scrape = F.struct(
        F.when(n % 9 != 0, F.concat(F.lit("app"), ident)).otherwise("").alias("appId"),
        F.when(n % 4 == 1, F.array(F.lit("us"), F.when(n % 8 == 1, "usa").otherwise("gb"))).alias("countries"),
        F.when(n % 5 == 0, (n % 13).cast("int")).alias("pages"),
    )
    label = F.struct(
        F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), ident))).alias("reviewIds"),
        F.when(n % 3 == 0, (n % 120).cast("int")).alias("batchSize"),
    )
    process = F.struct(
        F.concat(F.lit("job"), ident).alias("sourceJobId"),
        F.when(n % 6 == 0, "other").otherwise("labeled_reviews").alias("resultType"),
    )
    clean = F.struct(
        F.lit("old_reviews").alias("targetType"), F.when(n % 2 == 0, (n % 40).cast("int")).alias("olderThanDays")
    )
    export = F.struct(
        F.lit("src1").alias("appId"),
        F.when(
            n % 3 == 0,
            F.struct(
                F.when(n % 6 == 0, "invalid-date").otherwise("2024-01-01T00:00:00Z").alias("startDate"),
                F.lit("2024-02-01T00:00:00.000Z").alias("endDate"),
            ),
        ).alias("dateRange"),
        F.when(n % 11 == 0, 11).alias("priority"),
    )
    payload = (
        F.when(c("type") == "scrape_reviews", F.to_json(scrape))
        .when(c("type") == "label_reviews", F.to_json(label))
        .when(c("type") == "process_results", F.to_json(process))
        .when(c("type") == "cleanup_data", F.to_json(clean))
        .otherwise(F.to_json(export))
    )
    return T.job_table(spark, sf_dir).withColumn("payload", payload).withColumn(
        "type", F.when(n % 50 == 49, "other_type").otherwise(c("type"))
    )


@register
def validate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = validate.validate_jobs(_payload_jobs(spark, sf_dir))
    return bad.select("id", "type", F.array_join("errors", "; ").alias("errors"))


@register
def accepted_job_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = validate.validate_jobs(_payload_jobs(spark, sf_dir))
    return ok.select(
        "id",
        "type",
        *[
            F.get_json_object("payload", f"$.{name}").cast("int").alias(column)
            for name, column in (
                ("pages", "pages"), ("throttleMs", "throttle_ms"), ("batchSize", "batch_size"),
                ("olderThanDays", "older_than_days"), ("priority", "priority"), ("retryAttempts", "retry_attempts"),
            )
        ],
        F.get_json_object("payload", "$.model").alias("model"),
        F.get_json_object("payload", "$.format").alias("format"),
        F.get_json_object("payload", "$.outputFormat").alias("output_format"),
    )


@register
def validate_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("id")
    result = F.to_json(
        F.struct(
            F.when(n % 10 != 0, n % 3 == 0).alias("success"),
            F.when(n % 4 == 0, n - 40).alias("itemsProcessed"),
            F.when(n % 6 == 0, n / 4).alias("processingTime"),
        )
    )
    _, bad = validate.validate_job_results(T.job_table(spark, sf_dir).select("id", result.alias("result")))
    return bad.select("id", F.array_join("errors", "; ").alias("errors"))


# --- merge and joins -----------------------------------------------------------------------------------------


def _review_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored two thirds of the reviews, incoming five sixths of them with other values)."""
    n = F.substring("id", 2, 20).cast("bigint")
    rows = T.stored_reviews(spark, sf_dir)
    target = rows.where(n % 3 != 0)
    source = rows.where(n % 6 != 1).withColumns(
        {
            "app_id": F.concat(F.lit("other_"), "app_id"),
            "user_name": F.lit("someone"),
            "score": (c("score") % 5 + 1).cast("int"),
            "title": F.concat(F.lit("new "), "title"),
            "helpful_votes": c("helpful_votes") + 100,
        }
    )
    return target, source.drop("created_at", "updated_at")


_UPSERTED = ("id", "app_id", "user_name", "score", "title", "text", "helpful_votes", "country", "created_at", "updated_at")


@register
def upsert_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _review_changes(spark, sf_dir)
    return _iso(merge.upsert_reviews(target, source, T.AS_OF).select(*_UPSERTED), "created_at", "updated_at")


@register
def upsert_touched_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a stored table of which only the touched parts are read and written."""
    target, source = _review_changes(spark, sf_dir)
    tables = Versions(spark, _scratch(spark, "parts"))
    run = tables.begin()
    run.put("reviews", target.select("*", merge.part_of_key("id", merge.REVIEW_UPDATES, 16)))
    run.publish()
    maintain.put_reviews(tables, source, T.AS_OF, parts=16)
    return _iso(maintain.current(tables, "reviews").select(*_UPSERTED), "created_at", "updated_at")


@register
def theme_insights_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme statistics kept up over three label batches: new labels, labels of other reviews, relabeled ones."""
    n = c("ord")
    rows = T.analysis_columns(spark, sf_dir).select(
        "ord", "review_id", F.coalesce("theme", F.lit("none")).alias("theme"), "sentiment", "severity",
        (c("feature_request") == "Y").alias("feature_request"), "direct_quote",
        c("confidence").cast(S.CONFIDENCE).alias("confidence"), F.lit("m1").alias("model_version"),
    )
    again = rows.where(n % 5 == 0).withColumns(
        {"theme": F.concat(F.lit("theme_"), (n % 4).cast("string")), "sentiment": F.lit("negative"), "feature_request": n % 2 == 0}
    )
    tables = Versions(spark, _scratch(spark, "insights"))
    for batch, day in ((rows.where(n % 3 != 0), T.AS_OF), (rows.where(n % 3 == 0), T.LATER), (again, T.LATEST)):
        maintain.put_labels(tables, batch.drop("ord"), day, parts=8)
    stats = maintain.maintained_stats(tables)
    first = {name: F.timestamp_micros(name) for name in ("first_ord", "first_request_ord")}
    return _iso(stats.where("mentions > 0").withColumns(first), *first)


@register
def upsert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the labels stored, all of them coming in again with another theme."""
    rows = T.stored_labels(spark, sf_dir)
    target = rows.where(F.substring("id", 2, 20).cast("bigint") % 2 == 0)
    source = rows.withColumns({"theme": F.lit("Relabeled"), "model_version": F.lit("m2")})
    merged = merge.upsert_labels(target, source.drop("id", "created_at", "updated_at"), T.LATER)
    return _iso(merged, "created_at", "updated_at").withColumn("confidence", c("confidence").cast("double"))


@register
def ensure_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.lit(T.AS_OF).cast("timestamp")
    wanted = _apps(spark, sf_dir).select(c("app_id").alias("id"))
    source = normalize.normalize_apps(wanted, _fetched_apps(spark, sf_dir))
    known = wanted.where(c("id").endswith("1") | c("id").endswith("2")).select(
        "id", F.lit(S.UNKNOWN_APP).alias("title"),
        *[F.lit(None).cast("string").alias(name) for name in ("description", "version", "developer", "category")],
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    return _iso(merge.ensure_apps(known, source, T.LATER), "created_at", "updated_at")


@register
def reviews_to_store_across_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review also under a second app: the first app keeps its columns, the last one sets the updates."""
    raw = T.raw_reviews(spark, sf_dir)
    second = raw.withColumns(
        {"app_id": F.lit("zz"), "app_ord": F.lit(1_000_000).cast("bigint"), "score": F.lit(1), "user_name": F.lit("late")}
    )
    stored = reviews_to_store(check_reviews(raw.unionByName(second)).accepted)
    return stored.select("id", "app_id", "user_name", "country", "score", "title", "text", "helpful_votes")


@register
def unlabeled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = backlog.unlabeled_reviews(T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir))
    return _iso(picked.select("id", "app_id", "score", "text", "created_at"), "created_at")


@register
def unlabeled_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = backlog.unlabeled_reviews(T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir), limit=None)
    return rest.select("id", "app_id", "score", "text")


@register
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = T.stored_labels(spark, sf_dir).where(c("sentiment") == "negative")
    return backlog.skip_done(T.stored_reviews(spark, sf_dir), done, "review_id").select("id", "app_id")


@register
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.stored_labels(spark, sf_dir).where("feature_request").select(c("review_id").alias("id"))
    return _iso(backlog.reviews_by_ids(T.stored_reviews(spark, sf_dir), ids).select("id", "text", "created_at"), "created_at")


@register
def enrich_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = backlog.enrich_reviews(T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir))
    return both.select("id", "app_id", "theme", "sentiment", "severity", "feature_request", "direct_quote")


@register
def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = T.stored_reviews(spark, sf_dir).where(c("country") == "US")
    return merge.orphans(T.stored_labels(spark, sf_dir), reviews, "review_id", "id").select("review_id", "theme")


@register
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = T.stored_reviews(spark, sf_dir).where(c("score") == 1)
    return merge.cascade_delete(T.stored_labels(spark, sf_dir), gone, "review_id").select("review_id", "theme")


# --- labeling ------------------------------------------------------------------------------------------------


def _to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(
        T.review_id(c("doc_id")).alias("id"), c("source").alias("app_id"), c("doc_id").alias("ord"), "text"
    )


@register
def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.number_batches(_to_label(spark, sf_dir).select("id", "ord"), [c("ord").asc()])


@register
def label_batches_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _to_label(spark, sf_dir).select("id", "app_id", "ord")
    return backlog.number_batches(rows, [c("ord").desc()], 7, ["app_id"])


@register
def label_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = backlog.label_jobs(backlog.number_batches(_to_label(spark, sf_dir).select("id", "ord"), [c("ord").asc()]))
    return made.select("batch_no", F.array_join("review_ids", ",").alias("review_ids"), "batch_size", "model", "retry_attempts")


@register
def label_requests_untexted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over reviews of which some have no text; each still has its place in the prompt."""
    batches = backlog.number_batches(_to_label(spark, sf_dir).drop("app_id"), [c("ord").asc()])
    made = labeling.label_requests(
        batches.withColumn("text", F.when(c("position") % 4 != 2, c("text"))), S.DEFAULT_TAXONOMY
    )
    return made.select("batch_no", F.size("review_ids").alias("n"), "user_prompt")


@register
def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = backlog.number_batches(_to_label(spark, sf_dir).drop("app_id"), [c("ord").asc()])
    made = labeling.label_requests(batches, S.DEFAULT_TAXONOMY)
    return made.select("batch_no", F.array_join("review_ids", ",").alias("review_ids"), "user_prompt")


def _elements_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response element per document, with the kinds of value models return."""
    n = c("doc_id")
    element = F.to_json(
        F.struct(
            T.review_id(n).alias("reviewId"),
            F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("theme_"), (n % 7).cast("string"))).alias("theme"),
            F.when(n % 4 == 0, "POSITIVE").when(n % 4 == 1, "positive").when(n % 4 == 2, "negative").alias("sentiment"),
            F.concat(((n % 9) - 2).cast("string"), F.lit(".7 of 5")).alias("severity"),
            F.when(n % 3 == 0, "no").when(n % 3 == 1, "").alias("featureRequest"),
            c("text").alias("directQuote"),
            F.when(n % 5 != 0, ((n % 150) / F.lit(100.0))).alias("confidence"),
        )
    )
    return T.table(spark, sf_dir, "documents").select("doc_id", element.alias("element"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents to a response. Shapes: bare array, object with results, and four that fail the batch."""
    no = F.floor(c("doc_id") / 10)
    batches = _elements_json(spark, sf_dir).groupBy(no.alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "element"))).alias("m")
    )
    array = F.concat(F.lit("["), F.array_join("m.element", ","), F.lit("]"))
    shape = c("batch_no") % 8
    content = (
        F.when(shape == 0, F.concat(F.lit('{"results":'), array, F.lit("}")))
        .when(shape == 1, F.lit(""))
        .when(shape == 2, F.concat(array, F.lit(" and more")))
        .when(shape == 3, F.lit('{"a":1}'))
        .when(shape == 4, F.concat(F.lit("[null,"), F.array_join("m.element", ","), F.lit("]")))
        .otherwise(array)
    )
    ids = F.transform("m.doc_id", T.review_id)
    return batches.select("batch_no", ids.alias("review_ids"), content.alias("content"))


def _as_double(labels: DataFrame) -> DataFrame:
    return labels.withColumn("confidence", c("confidence").cast("double"))


@register
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = _elements_json(spark, sf_dir).select(F.parse_json("element").alias("element"))
    return _as_double(normalize.clean_labels(elements, "m1"))


@register
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = labeling.parse_responses(_responses(spark, sf_dir))
    return _as_double(normalize.clean_labels(elements.drop("review_ids"), "m1"))


@register
def failed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.parse_responses(_responses(spark, sf_dir))[1].select("batch_no", F.size("review_ids").alias("reviews"))


@register
def fallback_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = _responses(spark, sf_dir)
    members = responses.select("batch_no", F.explode("review_ids").alias("id"))
    return _as_double(labeling.fallback_labels(labeling.parse_responses(responses)[1], members, "m1"))


@register
def labels_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(labeling.labels_from_responses(_responses(spark, sf_dir), "m1").drop("answer_ord"))


@register
def label_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labeling.label_reviews(_to_label(spark, sf_dir), S.DEFAULT_TAXONOMY, LABELER, model="m1", concurrency=_cores(spark))
    return _as_double(labels.drop("answer_ord"))


@register
def label_reviews_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes outside of the taxonomy become general feedback."""
    themes = [theme for theme in S.DEFAULT_TAXONOMY["themes"] if theme["name"] != "Pricing"]
    labels = labeling.label_reviews(
        _to_label(spark, sf_dir), {"themes": themes}, LABELER, model="m1", concurrency=_cores(spark), strict=True
    )
    return labels.select("review_id", "theme")


@register
def label_backlog_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred unlabeled reviews get labels."""
    run = label_backlog(
        T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir), S.DEFAULT_TAXONOMY, LABELER, T.LATER, limit=100,
        model="m2", concurrency=2,
    )
    return run.labels.where(c("model_version") == "m2").select("review_id", "theme", "sentiment", "severity")


def _backlog_run(spark: SparkSession, sf_dir: str):
    return label_backlog(
        T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir), S.DEFAULT_TAXONOMY, LABELER, T.LATER,
        limit=None, model="m2", concurrency=_cores(spark),
    )


@register
def label_backlog_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _backlog_run(spark, sf_dir).labels
    return _iso(_as_double(labels), "created_at", "updated_at")


@register
def label_backlog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backlog_run(spark, sf_dir).summary


@register
def label_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of ten ids each over all documents; a job whose reviews have no labels fails."""
    made = _responses(spark, sf_dir).select(c("batch_no").alias("job_id"), "review_ids")
    result = insights.label_job_summary(T.stored_labels(spark, sf_dir), made)
    return result.withColumn("failed_review_ids", F.array_join("failed_review_ids", ","))


@register
def label_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same jobs as results with the time they took; some ended with an error."""
    n = c("batch_no")
    start = T.hours_from_2024(n)
    runs = _responses(spark, sf_dir).select(
        n.alias("job_id"), "review_ids", start.alias("started_at"),
        F.timestamp_millis(F.unix_millis(start) + n * 17 % 1000).alias("finished_at"),
        F.when(n % 13 == 5, "Rate limit").alias("error"),
    )
    summary = insights.label_job_summary(T.stored_labels(spark, sf_dir), runs.select("job_id", "review_ids"))
    result = insights.label_results(summary, runs)
    return result.withColumn("failed_review_ids", F.array_join("failed_review_ids", ","))


# --- jobs and dead letters -----------------------------------------------------------------------------------


@register
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_stats(T.job_table(spark, sf_dir))


@register
def result_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("id")
    result = F.when(n % 7 != 0, F.to_json(F.struct((n % 3 != 0).alias("success"))))
    return jobs.result_stats(T.job_table(spark, sf_dir).withColumn("result", result)).drop("type_ord")


@register
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_health(T.job_table(spark, sf_dir), T.dead_letters(spark, sf_dir)).drop("type_ord")


@register
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_metrics(T.job_table(spark, sf_dir), T.dead_letters(spark, sf_dir))


@register
def processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(jobs.processing_stats(T.job_table(spark, sf_dir)), "oldest_waiting_job")


@register
def oldest_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(jobs.oldest_waiting(T.job_table(spark, sf_dir)), "oldest_waiting")


@register
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.recent_jobs(T.job_table(spark, sf_dir))
    return _iso(rows.select("type", "position", "id", "status", "created_at"), "created_at")


@register
def keep_last_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.keep_last_finished(T.job_table(spark, sf_dir)).select("id", "type", "status")


@register
def keep_last_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota beyond the size that windows serve, over jobs of which some have no type."""
    rows = T.job_table(spark, sf_dir).withColumn("type", _untyped("type"))
    return jobs.keep_last_finished(rows, 5000, 5000).select("id", "type", "status")


@register
def queue_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per type and recent job, with the counts of the bundle."""
    rows = deadletter.queue_details(T.job_table(spark, sf_dir), T.dead_letters(spark, sf_dir))
    return rows.select(
        "type", "failed", "dlq_total", c("by_failure_reason")["Rate limit"].alias("rate_limited"),
        F.size("recent_failures").alias("failures"), F.explode_outer("recent_jobs").alias("job"),
    ).select("type", "failed", "dlq_total", "rate_limited", "failures", "job.position", "job.id", "job.status")


@register
def cleanup_failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = deadletter.run_cleanup(
        "failed_jobs", T.stored_reviews(spark, sf_dir), T.job_table(spark, sf_dir), T.AS_OF, 10, dry_run=True
    )
    return gone.select("id", "type", "status")


@register
def clean_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = jobs.clean_queue(T.job_table(spark, sf_dir), T.AS_OF)
    return kept.select("id", "type", "status")


@register
def clean_queue_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, removed = jobs.clean_queue(T.job_table(spark, sf_dir), T.AS_OF)
    return removed.select("id", "type", "status")


@register
def job_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("id")
    rows = T.job_table(spark, sf_dir).select(
        "id",
        F.when(n % 4 != 0, (n % 3).cast("int")).alias("option_priority"),
        F.when(n % 5 == 0, (n % 1000).cast("int")).alias("option_delay"),
        F.lit(None).cast("int").alias("option_attempts"),
        (n % 11).cast("int").alias("priority"),
        F.lit(0).alias("delay"),
        (n % 6).cast("int").alias("retry_attempts"),
    )
    return jobs.resolve_job_options(rows).select("id", "resolved_priority", "resolved_delay", "resolved_attempts")


@register
def to_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.dead_letters(spark, sf_dir)
    return _iso(rows.select("id", "original_job_id", "original_job_type", "failure_reason", "attempts_made", "failed_at"), "failed_at")


@register
def dlq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = deadletter.dlq_stats(T.dead_letters(spark, sf_dir)).drop("type_ord")
    return _iso(stats, "oldest_failure", "newest_failure")


@register
def dlq_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.dlq_reasons(T.dead_letters(spark, sf_dir))


@register
def dlq_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = deadletter.dlq_overview(T.dead_letters(spark, sf_dir)).select(
        "type", "total", F.explode_outer("recent_jobs").alias("r")
    )
    return _iso(flat.select("type", "total", "r.position", "r.id", "r.failure_reason", "r.failed_at"), "failed_at")


@register
def recent_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.recent_dead_letters(T.dead_letters(spark, sf_dir)).select("original_job_type", "position", "id")


@register
def dead_letter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.dead_letter_page(T.dead_letters(spark, sf_dir), 10, 29).select("original_job_type", "position", "id")


@register
def dead_letter_long_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.dead_letter_page(T.dead_letters(spark, sf_dir), 5, 1999).select(
        "original_job_type", c("position").cast("bigint").alias("position"), "id"
    )


def _untyped(column: str):
    return F.when(c(column) != "export_data", c(column))


@register
def dead_letter_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of which some have no type; they page like a type of their own."""
    letters = T.dead_letters(spark, sf_dir).withColumn("original_job_type", _untyped("original_job_type"))
    return deadletter.dead_letter_page(letters, 0, -1).select("original_job_type", "position", "id")


@register
def dead_letter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.dead_letter_page(T.dead_letters(spark, sf_dir), 0, -1).select("original_job_type", "position", "id")


@register
def dlq_retry_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    retried, _ = deadletter.retry_by_reason(T.dead_letters(spark, sf_dir), "label_reviews", "Rate limit")
    return retried.select("id", "type", "priority", "delay", "max_attempts")


@register
def dlq_retry_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rest = deadletter.retry_by_reason(T.dead_letters(spark, sf_dir), "label_reviews", "Rate limit", max_jobs=3)
    return rest.select("id", "original_job_type")


@register
def dlq_retry_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of a retry by id: the new jobs and the dead letters that remain."""
    again, rest = deadletter.retry_dead_letter(T.dead_letters(spark, sf_dir), ["dlq_20", "dlq_60"])
    made = again.select(
        F.lit("retried").alias("half"), "id", "type", "status", "priority", "delay", "attempts", "max_attempts"
    )
    none = F.lit(None).cast("int")
    return made.unionByName(
        rest.select(
            F.lit("remaining").alias("half"), "id", c("original_job_type").alias("type"), "status",
            *[none.alias(name) for name in ("priority", "delay", "attempts", "max_attempts")],
        )
    )


@register
def dlq_retry_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries by id and by reason, each published as one step; what the stored tables hold after both."""
    tables = Versions(spark, _scratch(spark, "letters"))
    retry.put_dead_letters(tables, T.dead_letters(spark, sf_dir))
    retry.retry_letters(tables, ["dlq_20", "dlq_60"])
    retry.retry_reason(tables, "label_reviews", "Rate limit", max_jobs=3)
    made = retry.retried(tables).select(F.lit("retried").alias("half"), "id", "type")
    return made.unionByName(
        retry.dead_letters(tables).select(F.lit("remaining").alias("half"), "id", c("original_job_type").alias("type"))
    )


@register
def dlq_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of which every other one was closed; old closed ones go."""
    rows = T.dead_letters(spark, sf_dir).withColumn(
        "status", F.when(c("original_job_id").cast("bigint") % 40 == 0, "failed").otherwise("waiting")
    )
    kept, _ = deadletter.clean_dead_letters(rows, T.AS_OF)
    return kept.select("id", "status")


@register
def cleanup_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = deadletter.cleanup(T.stored_reviews(spark, sf_dir), "date", T.AS_OF, dry_run=True)
    return gone.select("id", "app_id")


@register
def cleanup_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.cleanup(T.stored_reviews(spark, sf_dir), "date", T.AS_OF).select("id", "app_id")


# --- sinks, logs, health, SQL --------------------------------------------------------------------------------


@register
def export_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = writers.export_reviews(
        T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir), "src3", end=T.AS_OF
    )
    return _iso(rows.select("id", "date", "score", "text", "theme", "sentiment", "severity"), "date")


@register
def reviews_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review CSV written and read back."""
    path = _scratch(spark, "csv")
    writers.write_reviews_csv(T.stored_reviews(spark, sf_dir), path)
    back = readers.read_reviews_csv(spark, path)
    return back.select(
        "id", c("Country").alias("country"), c("User Name").alias("user_name"), c("Rating").cast("int").alias("rating"),
        c("Review Title").alias("title"), "text", c("Review Date").alias("date"), c("Review URL").alias("url"),
        c("Helpful Votes").cast("int").alias("votes"),
    )


@register
def reviews_csv_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review CSV, written by all tasks, read back by byte ranges."""
    path = _scratch(spark, "csv-large")
    writers.write_reviews_csv(T.stored_reviews(spark, sf_dir), path)
    rows = readers.read_large_reviews_csv(spark, path)
    return rows.select(
        "id", c("Country").alias("country"), c("User Name").alias("user_name"), c("Rating").cast("int").alias("rating"),
        c("Review Title").alias("title"), "text", c("Review Date").alias("date"), c("Review URL").alias("url"),
        c("Helpful Votes").cast("int").alias("votes"),
    )


@register
def reviews_csv_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per app folder of the CSV files."""
    path = _scratch(spark, "csv-by-app")
    apps = normalize_apps(spark, sf_dir)
    writers.write_reviews_csv_by_app(T.stored_reviews(spark, sf_dir), apps, path)
    rows = readers.read_reviews_csv(spark, path)
    return rows.groupBy("app").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@register
def export_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export as its job asks for it: JSON, without labels, within two dates."""
    path = _scratch(spark, "export")
    job = {
        "appId": "src3", "format": "json", "includeLabels": False,
        "dateRange": {"startDate": "2024-01-03T00:00:00+00:00", "endDate": "2024-03-01T00:00:00+00:00"},
    }
    writers.run_export(T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir), job, path)
    return spark.read.schema("id string, score int, text string, helpful_votes int").json(path)


@register
def labeled_reviews_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled reviews appended in two runs, the second one for what the first had left."""
    path = _scratch(spark, "labeled")
    reviews, labels = T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir)
    writers.append_labeled_csv(reviews.where(c("country") == "US"), labels, path)
    done = readers.read_reviews_csv(spark, path)
    writers.append_labeled_csv(backlog.skip_done(reviews, done), labels, path)
    back = readers.read_reviews_csv(spark, path)
    return back.select("id", c("Country").alias("country"), "theme", "sentiment", c("severity").cast("int").alias("severity"), "feature_request")


@register
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and labels stored, read back and joined."""
    root = _scratch(spark, "tables")
    writers.write_table(T.stored_reviews(spark, sf_dir), root, "reviews")
    writers.write_table(T.stored_labels(spark, sf_dir), root, "labels")
    reviews, labels = readers.read_table(spark, root, "reviews"), readers.read_table(spark, root, "labels")
    return reviews.join(labels.withColumnRenamed("id", "label_id"), reviews.id == labels.review_id).groupBy(
        "app_id", "sentiment"
    ).agg(F.count("*").alias("n"), F.sum("score").alias("total_score"))


@register
def bucketed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and labels stored in buckets of their key and joined without a shuffle."""
    tag = uuid4().hex
    for name, frame, key in (
        ("reviews", T.stored_reviews(spark, sf_dir), "id"), ("labels", T.stored_labels(spark, sf_dir), "review_id")
    ):
        writers.write_bucketed(frame, f"{name}_{tag}", key, 8, _scratch(spark, name))
    reviews, labels = spark.table(f"reviews_{tag}"), spark.table(f"labels_{tag}")
    return backlog.enrich_reviews(reviews, labels).groupBy("theme").agg(
        F.count("*").alias("n"), F.sum("score").alias("total_score")
    )


@register
def analyses_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses written as JSON lines, read back and aggregated per theme."""
    path = _scratch(spark, "analyses")
    fields = F.struct("theme", "sentiment", "severity", "feature_request")
    T.analysis_columns(spark, sf_dir).select("ord", fields.alias("analysis")).write.json(path)
    stats = insights.insight_stats(normalize.normalize_analyses(readers.read_analyses(spark, path, lines=True)))
    return insights.theme_insights(stats).select("theme", "mentions", "negative", "average_severity", "first_ord")


@register
def analyses_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same analyses in one document with an array, split for reading."""
    path = _scratch(spark, "document")
    fields = F.struct("theme", "sentiment", "severity", "feature_request")
    rows = T.analysis_columns(spark, sf_dir).select(F.to_json(F.struct("ord", fields.alias("analysis"))).alias("value"))
    # The parts of the document are lines of one file, in any order of the records.
    spaced = rows.select(F.concat("value", F.lit(",")).alias("value"))
    head = spark.createDataFrame([('{"source": "a \\"}\\" b", "analyses": [',)], "value string")
    tail = spark.createDataFrame([('{"ord": null, "analysis": null}], "done": true}',)], "value string")
    head.unionByName(spaced).unionByName(tail).coalesce(1).write.text(path)
    records = readers.read_large_analyses(spark, path).withColumn("ord", F.try_variant_get("record", "$.ord", "bigint"))
    stats = insights.insight_stats(normalize.normalize_analyses(records))
    return insights.theme_insights(stats).select("theme", "mentions", "negative", "average_severity", "first_ord")


@register
def taxonomy_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy written as a document and read back, with the built-in one where a document cannot be read."""
    path, broken = _scratch(spark, "taxonomy"), _scratch(spark, "taxonomy")
    theme = F.struct(c("n_nationkey"), c("n_name").alias("name"), c("r_comment").alias("description"))
    joined = T.table(spark, sf_dir, "nation").join(
        T.table(spark, sf_dir, "region").select(c("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("r_comment")), "n_regionkey"
    )
    listed = F.transform(F.sort_array(F.collect_list(theme)), lambda t: t.dropFields("n_nationkey"))
    document = joined.agg(F.to_json(F.struct(listed.alias("themes"))).alias("value"))
    document.write.text(path)
    document.select(F.substring("value", 1, 40).alias("value")).write.text(broken)
    parts = [
        readers.taxonomy_table(spark, readers.load_taxonomy(spark, where)).select(
            F.lit(name).alias("document"), "ord", "name", "description"
        )
        for name, where in (("whole", path), ("cut off", broken), ("missing", f"{path}-none"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register
def result_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job result written in each of the three formats; rows per format and theme when read back."""
    rows = T.stored_labels(spark, sf_dir).select("review_id", "theme")
    paths = {fmt: _scratch(spark, fmt) for fmt in validate.OUTPUT_FORMATS}
    for fmt, path in paths.items():
        writers.write_result(rows, path, fmt)
    schema = "review_id string, theme string"
    read = {
        "csv": spark.read.options(**readers.CSV_OPTIONS).schema(schema).csv(paths["csv"]),
        "json": spark.read.schema(schema).json(paths["json"]),
        "database": spark.read.schema(schema).parquet(paths["database"]),
    }
    parts = [df.withColumn("fmt", F.lit(fmt)) for fmt, df in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("fmt", "theme").agg(F.count("*").alias("n"))


@register
def result_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type of result written in a format of its own as its job asks for it, and read back."""
    reviews, labels = T.stored_reviews(spark, sf_dir), T.stored_labels(spark, sf_dir).where("severity > 2")
    jobs_in = [
        {"sourceJobId": "j1", "resultType": "scraped_reviews", "outputFormat": "csv"},
        {"sourceJobId": "j2", "resultType": "labeled_reviews", "outputFormat": "json"},
        {"sourceJobId": "j3", "resultType": "exported_data"},
    ]
    paths = [_scratch(spark, job["resultType"]) for job in jobs_in]
    for job, path in zip(jobs_in, paths):
        writers.run_process_results(reviews, labels, job, path)
    none = F.lit(None).cast("string")
    scraped = readers.read_reviews_csv(spark, paths[0]).select("id", c("Rating").cast("int").alias("score"), none.alias("theme"))
    labeled = spark.read.schema("`Review ID` string, Rating int, theme string").json(paths[1])
    exported = spark.read.schema("id string, score int, theme string").parquet(paths[2])
    kinds = [job["resultType"] for job in jobs_in]
    found = [df.toDF("id", "score", "theme").withColumn("result_type", F.lit(kind)) for df, kind in zip((scraped, labeled, exported), kinds)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = T.table(spark, sf_dir, "events").select(
        F.concat(F.lit("service"), (c("user_id") % 50).cast("string")).alias("service"),
        c("event_type").alias("name"),
        F.when(c("value") > 60, "unhealthy").when(c("value") > 40, "degraded").otherwise("healthy").alias("status"),
        (c("event_type") == "error").alias("critical"),
        (c("event_id") % 997 == 0).alias("timed_out"),
    )
    return ops.health_rollup(checks)


@register
def redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.redact_logs(T.log_table(spark, sf_dir)).select(
        "id", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("members")
    )


@register
def sample_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_debug_logs(T.log_table(spark, sf_dir)).select("id", "level")


@register
def sample_logs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per level that sampling never drops."""
    kept = ops.sample_debug_logs(T.log_table(spark, sf_dir)).where(c("level") != "debug")
    return kept.groupBy("level").agg(F.count("*").alias("n"))


@register
def parameterized_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    T.stored_reviews(spark, sf_dir).createOrReplaceTempView("echolens_reviews")
    text = "SELECT country, count(*) AS n FROM echolens_reviews WHERE score >= ? AND country <> ? GROUP BY country"
    return query.run_sql(spark, text, [3, "GB"])


@register
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = T.job_table(spark, sf_dir).where(c("status") == "failed").orderBy(c("created_at").desc(), c("id"))
    return query.first_row(ordered.select("id", "type"))


@register
def exists_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = T.job_table(spark, sf_dir).where(c("status") == "failed")
    n = query.count_df(failed)
    return n.withColumn("exists", query.exists_df(failed).scalar())


# --- streaming -----------------------------------------------------------------------------------------------

DRAIN = {"availableNow": True}


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them; by a pattern, as a stream's plain path must be a folder."""
    schema = T.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@register
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed page files through the stream with early stop; the same reviews as the batch path stores."""
    root = _scratch(spark, "ingest")
    review_streams.stream_ingest(spark, _land(spark, sf_dir), root, f"{root}/checkpoint", DRAIN, T.AS_OF).awaitTermination()
    rows = review_streams.current_reviews(spark, root)
    return _iso(
        rows.select("id", "app_id", "user_name", "score", "title", "text", "date", "helpful_votes", "country", "updated_at"),
        "date", "updated_at",
    )


class _Ghosts:
    """A labeler that also answers for reviews nobody asked about."""

    def __call__(self, prompt: str, batch: list[tuple[str, str]]) -> str:
        answers = [{"reviewId": i, "theme": "Features"} for i, _ in batch]
        answers += [{"reviewId": "ghost" + i[1:], "theme": "Features"} for i, _ in batch if i.endswith("3")]
        return json.dumps(answers)


@register
def stream_label_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "ghosts")
    raw = T.appearances(_stream(spark, sf_dir, "documents"))
    review_streams.ingest_raw(raw, root, f"{root}/checkpoint", DRAIN, T.AS_OF).awaitTermination()
    review_streams.stream_label(
        spark, root, f"{root}/checkpoint-label", S.DEFAULT_TAXONOMY, _Ghosts(), trigger=DRAIN, as_of=T.AS_OF
    ).awaitTermination()
    return spark.read.schema("review_id string").parquet(f"{root}/{review_streams.UNMATCHED}").select("review_id")


@register
def stream_ingest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "ingest")
    raw = T.appearances(_stream(spark, sf_dir, "documents"))
    review_streams.ingest_raw(raw, root, f"{root}/checkpoint", DRAIN, T.AS_OF).awaitTermination()
    rows = review_streams.current_reviews(spark, root)
    return _iso(rows.select("id", "app_id", "user_name", "score", "title", "text", "helpful_votes", "country", "updated_at"), "updated_at")


@register
def stream_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "label")
    raw = T.appearances(_stream(spark, sf_dir, "documents"))
    review_streams.ingest_raw(raw, root, f"{root}/checkpoint", DRAIN, T.AS_OF).awaitTermination()
    review_streams.stream_label(
        spark, root, f"{root}/checkpoint-label", S.DEFAULT_TAXONOMY, LABELER, model="m1", trigger=DRAIN, as_of=T.AS_OF
    ).awaitTermination()
    rows = review_streams.current_labels(spark, root)
    return _as_double(rows).select("review_id", "theme", "sentiment", "severity", "feature_request", "direct_quote", "confidence")


@register
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "dedup")
    raw = T.appearances(_stream(spark, sf_dir, "documents")).select("id", "date")
    sink = review_streams.stream_dedup(raw, "date", "1 hour").writeStream.format("parquet")
    sink.option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(**DRAIN).start().awaitTermination()
    return _iso(spark.read.schema("id string, date timestamp").parquet(f"{root}/out"), "date")


@register
def stream_queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "status")
    jobs_in = T.jobs_of(_stream(spark, sf_dir, "events"))
    job_streams.stream_queue_status(jobs_in, root, f"{root}/checkpoint", DRAIN, "created_at").awaitTermination()
    return job_streams.queue_status(spark, root).withColumnRenamed("jobs", "n")


@register
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several states of each job in one stream: each job counts once, in its last state."""
    root = _scratch(spark, "states")
    told = T.job_states_of(_stream(spark, sf_dir, "events"))
    job_streams.stream_queue_status(told, root, f"{root}/checkpoint", DRAIN).awaitTermination()
    return job_streams.queue_status(spark, root)


@register
def stream_queue_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "activity")
    jobs_in = T.jobs_of(_stream(spark, sf_dir, "events"))
    # Label jobs are all finished here, so that their type is idle.
    finished = F.when(c("type") == "label_reviews", "completed").otherwise(c("status"))
    stream = job_streams.stream_queue_status(
        jobs_in.withColumn("status", finished), root, f"{root}/checkpoint", DRAIN, "created_at"
    )
    stream.awaitTermination()
    return job_streams.queue_activity(spark, root)


@register
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _scratch(spark, "quarantine")
    jobs_in = T.jobs_of(_stream(spark, sf_dir, "events")).withColumn(
        "payload", F.when(c("id") % 5 == 0, "{}").otherwise('{"appId":"a","sourceJobId":"j","resultType":"exported_data","targetType":"old_reviews","reviewIds":["r1"]}')
    )
    job_streams.stream_quarantine(jobs_in, root, f"{root}/checkpoint", DRAIN).awaitTermination()
    letters = spark.read.schema(S.DEAD_LETTERS).parquet(f"{root}/dead_letters")
    accepted = spark.read.schema("id bigint, type string, payload string").parquet(f"{root}/accepted")
    half = F.lit("dead letter").alias("half")
    return letters.select(half, c("original_job_id").alias("id"), c("original_job_type").alias("type"), "failure_reason").unionByName(
        accepted.select(F.lit("accepted").alias("half"), c("id").cast("string").alias("id"), "type", F.lit(None).cast("string").alias("failure_reason"))
    )
