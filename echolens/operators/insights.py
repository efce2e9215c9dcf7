"""From analysed reviews to theme, sentiment and feature-request tables and a SWOT table.

``insight_stats`` is the only pass over the reviews. It yields one row per theme, and everything else is derived
from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.rounding import fixed, fixed_text, half_up
from echolens.sources.versions import PART

# Thresholds of the SWOT rules.
POSITIVE_SHARE = 0.65
NEGATIVE_SHARE = 0.30
HIGH_SEVERITY = 3.5
SIGNIFICANT_SHARE = 0.05
OVERALL_POSITIVE = 0.6
OVERALL_NEGATIVE = 0.3

# Messages of the results of label jobs.
LABELED = "Successfully labeled %d reviews"
NO_REVIEWS = "No reviews found for provided IDs: %s..."
BACKLOG_EMPTY = "No unlabeled reviews found"
BACKLOG_LABELED = "Successfully labeled %d previously unlabeled reviews"

# Wording of the SWOT rows and of the report.
THEME_STRENGTH = "High user satisfaction with '%s' (%s%% Positive of %d mentions)."
THEME_WEAKNESS = "Significant user dissatisfaction with '%s' (%s%% Negative of %d mentions, Avg Severity: %s)."
THEME_THREAT = "High severity issues reported for '%s' (Avg Severity: %s) could lead to user churn."
OVERALL_STRENGTH = "Generally positive sentiment across reviews (%s%% Positive of processed)."
OVERALL_WEAKNESS = "Notable overall negative sentiment across reviews (%s%% Negative of processed)."
REQUESTS_FOUND = "Active user suggestions for features (%d requests identified, ~%s%% of processed reviews)."
REQUEST_THEMES = "Top themes associated with feature requests: %s."
NO_REQUESTS = "Limited explicit feature requests identified in this dataset."
SEVERE_CHANCE = "Opportunity to improve user retention by addressing high-severity issues in '%s'."
MILD_CHANCE = "Opportunity to improve user satisfaction by addressing issues related to '%s'."
SECTIONS = (
    ("strengths", "(No significant strengths identified based on current thresholds)"),
    ("weaknesses", "(No significant weaknesses identified based on current thresholds)"),
    ("opportunities", "(No specific opportunities identified from requests or weaknesses)"),
    ("threats", "(No significant threats identified based on high severity or other factors)"),
)


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


# --- one pass over the reviews -------------------------------------------------------------------------------


def insight_stats(analyses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per theme plus one row with a NULL theme that counts the skipped records, for each value of ``by``.

    Input: normalised analyses (ord, skipped, theme, sentiment, severity, feature_request). Only fixed-width
    buffers, so the aggregation is combined in each task before the shuffle.
    """
    negative = F.col("sentiment") == "negative"
    known = F.col("sentiment").isin("positive", "negative")
    asks = F.col("feature_request") == "Y"
    return (
        analyses.groupBy(*by, F.when(~F.col("skipped"), F.col("theme")).alias("theme"))
        .agg(
            F.count("*").alias("mentions"),
            F.count_if(F.col("sentiment") == "positive").alias("positive"),
            F.count_if(negative).alias("negative"),
            F.count_if(~known).alias("neutral"),
            F.coalesce(F.sum(F.when(negative, F.col("severity"))), F.lit(0.0)).alias("severity_sum"),
            F.count_if(negative).alias("severity_count"),
            F.count_if(asks).alias("requests"),
            F.min("ord").alias("first_ord"),
            F.min(F.when(asks, F.col("ord"))).alias("first_request_ord"),
        )
    )


def fold_stats(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``insight_stats`` of all rows from those of their parts."""
    least = ("first_ord", "first_request_ord")
    counted = [name for name in partials.columns if name not in (*by, PART, "theme", *least)]
    return partials.groupBy(*by, "theme").agg(
        *[F.sum(name).alias(name) for name in counted], *[F.min(name).alias(name) for name in least]
    )


def stat_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes of the counts and sums per theme between two sets of partials; themes without a change go."""
    counted = [n for n in before.columns if n not in (PART, "theme", "first_ord", "first_request_ord")]
    signed = before.select("theme", *[(-F.col(n)).alias(n) for n in counted]).unionByName(after.select("theme", *counted))
    summed = signed.groupBy("theme").agg(*[F.sum(n).alias(n) for n in counted])
    return summed.where(reduce(or_, [F.col(n) != 0 for n in counted]))


def theme_insights(stats: DataFrame) -> DataFrame:
    """Per theme: mentions, sentiment counts and the average severity of negative mentions, 0 when none."""
    average = F.when(
        F.col("severity_count") > 0, fixed(F.col("severity_sum") / F.col("severity_count"), 2)
    ).otherwise(F.lit(0.0))
    return stats.where(F.col("theme").isNotNull()).withColumn("average_severity", average)


def overall_sentiment(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("theme").isNotNull()).agg(_total("positive"), _total("negative"), _total("neutral"))


def feature_requests(stats: DataFrame) -> DataFrame:
    """Requests per theme, for themes with any."""
    return stats.where(F.col("theme").isNotNull() & (F.col("requests") > 0)).select(
        "theme", "requests", "first_request_ord"
    )


def insight_totals(stats: DataFrame) -> DataFrame:
    """One row: total, skipped and processed reviews, and feature requests among the processed."""
    valid = F.col("theme").isNotNull()
    return stats.agg(
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("total_reviews"),
        F.coalesce(F.sum(F.when(~valid, F.col("mentions"))), F.lit(0)).alias("skipped_reviews"),
        F.coalesce(F.sum(F.when(valid, F.col("mentions"))), F.lit(0)).alias("processed_reviews"),
        F.coalesce(F.sum(F.when(valid, F.col("requests"))), F.lit(0)).alias("feature_requests"),
    )


def top_request_themes(requests: DataFrame, n: int = 5) -> DataFrame:
    return requests.orderBy(F.desc("requests"), "first_request_ord", "theme").limit(n)


def feature_request_quotes(analyses: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` feature requests in input order, a distributed top-k."""
    return (
        analyses.where(~F.col("skipped") & (F.col("feature_request") == "Y"))
        .select("ord", "theme", F.col("direct_quote").alias("quote"), "review_id")
        .orderBy("ord")
        .limit(n)
    )


# --- SWOT ----------------------------------------------------------------------------------------------------


def _entry(condition: Column, category: str, section: int, message: Column) -> Column:
    return F.when(
        condition, F.struct(F.lit(category).alias("category"), F.lit(section).alias("section"), message.alias("message"))
    )


def _entries(rows: DataFrame, order: Column, *entries: Column) -> DataFrame:
    return rows.select(order.alias("place"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select(
        "place", "e.*"
    )


def theme_flags(themes: DataFrame, totals: DataFrame) -> DataFrame:
    """Themes with their shares and flags. At most 20 are significant, as each has 5% of the processed reviews."""
    c = F.col
    processed = totals.select("processed_reviews").scalar()
    return (
        themes.withColumn("is_significant", F.try_divide(c("mentions"), processed) >= SIGNIFICANT_SHARE)
        .withColumns({"positive_share": c("positive") / c("mentions"), "negative_share": c("negative") / c("mentions")})
        .withColumns(
            {
                "is_strength": c("is_significant") & (c("positive_share") >= POSITIVE_SHARE),
                "is_weakness": c("is_significant") & (c("negative_share") >= NEGATIVE_SHARE),
                "is_threat": c("is_significant")
                & (c("negative_share") >= NEGATIVE_SHARE)
                & (c("average_severity") >= HIGH_SEVERITY),
            }
        )
    )


def swot(themes: DataFrame, overall: DataFrame, requests: DataFrame, totals: DataFrame) -> DataFrame:
    """(category, ord, message). Rows follow the order in which themes were first seen, overall rows last."""
    c = F.col
    severity = fixed_text(c("average_severity"), 2)
    weak, severe = c("is_weakness"), c("average_severity") >= HIGH_SEVERITY

    def percent(share: Column, digits: int = 0) -> Column:
        return fixed_text(share * 100, digits)

    by_theme = _entries(
        theme_flags(themes, totals).where("is_significant"),
        c("first_ord"),
        _entry(
            c("is_strength"), "strengths", 0,
            F.format_string(THEME_STRENGTH, "theme", percent(c("positive_share")), "mentions"),
        ),
        _entry(
            weak, "weaknesses", 0,
            F.format_string(THEME_WEAKNESS, "theme", percent(c("negative_share")), "mentions", severity),
        ),
        _entry(c("is_threat"), "threats", 0, F.format_string(THEME_THREAT, "theme", severity)),
        _entry(
            weak, "opportunities", 2,
            F.when(severe, F.format_string(SEVERE_CHANCE, "theme")).otherwise(F.format_string(MILD_CHANCE, "theme")),
        ),
    )
    processed = totals.select("processed_reviews").scalar()
    overall_rows = overall.withColumns(
        {
            "positive_share": F.try_divide(c("positive"), processed),
            "negative_share": F.try_divide(c("negative"), processed),
        }
    )
    by_overall = _entries(
        overall_rows,
        F.lit(0).cast("bigint"),
        _entry(
            c("positive_share") > OVERALL_POSITIVE, "strengths", 1,
            F.format_string(OVERALL_STRENGTH, percent(c("positive_share"))),
        ),
        _entry(
            c("negative_share") > OVERALL_NEGATIVE, "weaknesses", 1,
            F.format_string(OVERALL_WEAKNESS, percent(c("negative_share"))),
        ),
    )
    some = c("feature_requests") > 0
    by_requests = _entries(
        totals.where(c("processed_reviews") > 0),
        F.lit(0).cast("bigint"),
        _entry(
            some, "opportunities", 0,
            F.format_string(
                REQUESTS_FOUND, "feature_requests", percent(F.try_divide(c("feature_requests"), c("processed_reviews")), 1)
            ),
        ),
        _entry(~some, "opportunities", 0, F.lit(NO_REQUESTS)),
    )
    ranked = F.array_sort(
        F.collect_list(F.struct((-c("requests")).alias("r"), c("first_request_ord").alias("o"), "theme"))
    )
    names = F.transform("_ranked", lambda e: F.format_string("%s (%d)", e["theme"], -e["r"]))
    by_request_theme = _entries(
        top_request_themes(requests).agg(ranked.alias("_ranked")),
        F.lit(0).cast("bigint"),
        _entry(F.size("_ranked") > 0, "opportunities", 1, F.format_string(REQUEST_THEMES, F.array_join(names, ", "))),
    )
    rows = by_theme.unionByName(by_overall).unionByName(by_requests).unionByName(by_request_theme)
    in_category = Window.partitionBy("category").orderBy("section", "place", "message")
    return rows.select("category", F.row_number().over(in_category).alias("ord"), "message")


def _sections(swot_rows: DataFrame) -> DataFrame:
    values = ", ".join(f"({at}, '{name}', '{line}')" for at, (name, line) in enumerate(SECTIONS))
    return swot_rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(section, category, placeholder)")


def swot_report(swot_rows: DataFrame) -> DataFrame:
    """The printed report: the four sections in order, with a fixed line for an empty one."""
    return (
        _sections(swot_rows)
        .join(swot_rows, "category", "left")
        .select("section", "category", F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("message", "placeholder").alias("line"))
    )


def swot_json(swot_rows: DataFrame) -> DataFrame:
    """The same as one JSON object; a SWOT table has at most a few dozen rows."""
    lists = swot_rows.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("ord", "message"))).alias("rows"))
    lists = _sections(swot_rows).join(lists, "category", "left").select(
        "category", F.coalesce(F.col("rows.message"), F.array().cast("array<string>")).alias("messages")
    )
    pivoted = [F.first(F.when(F.col("category") == name, F.col("messages")), True).alias(name) for name, _ in SECTIONS]
    return lists.agg(F.to_json(F.struct(*pivoted)).alias("swot"))


def insights_json(themes: DataFrame, overall: DataFrame, totals: DataFrame, quotes: DataFrame) -> DataFrame:
    """One JSON object with all insights, the input of a report elsewhere: one row, column ``insights``.

    ``themes`` is ``theme_insights``, ``quotes`` at most fifty rows of ``feature_request_quotes``. The object has an
    entry per theme, so it grows with the taxonomy and not with the reviews.
    """
    by_theme = F.struct(
        F.col("mentions").alias("count"), "positive", "negative", "neutral", F.col("severity_sum").alias("severitySum"),
        F.col("severity_count").alias("severityCount"), F.col("average_severity").alias("averageSeverity"),
    )
    entries = F.sort_array(F.collect_list(F.struct("first_ord", "theme", by_theme.alias("numbers"), "requests")))
    folded = themes.agg(entries.alias("entries"))
    asked = F.filter("entries", lambda e: e["requests"] > 0)

    def pairs(rows: Column, value: str) -> Column:
        return F.map_from_entries(F.transform(rows, lambda e: F.struct(e["theme"], e[value])))

    listed = quotes.agg(F.sort_array(F.collect_list(F.struct("ord", "theme", "quote", "review_id"))).alias("quotes"))
    shown = F.transform("quotes", lambda q: F.struct(q["theme"].alias("theme"), q["quote"].alias("quote"), q["review_id"].alias("review_id")))
    tone = overall.select(F.struct("positive", "negative", "neutral").alias("tone"))
    # Four frames of one row each.
    joined = folded.join(listed, how="cross").join(tone, how="cross").join(totals, how="cross")
    return joined.select(
        F.to_json(
            F.struct(
                F.col("total_reviews").alias("totalReviews"), pairs(F.col("entries"), "numbers").alias("themes"),
                F.struct(
                    F.col("feature_requests").alias("count"), pairs(asked, "requests").alias("themes"), shown.alias("quotes")
                ).alias("featureRequests"),
                F.col("tone").alias("overallSentiment"), F.col("skipped_reviews").alias("skippedReviews"),
            )
        ).alias("insights")
    )


# --- label summaries -----------------------------------------------------------------------------------------


def _average_confidence() -> Column:
    # The sum of decimals is exact, so the result does not depend on the order of the rows.
    total = F.sum(F.col("confidence").cast(S.CONFIDENCE)).cast("double")
    return F.coalesce(half_up(F.try_divide(total, F.count("confidence")), 2), F.lit(0.0)).alias("average_confidence")


def average_confidence(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*by).agg(_average_confidence())


def _breakdown() -> list[Column]:
    return [F.count_if(F.col("sentiment") == name).alias(name) for name in S.SENTIMENTS]


def sentiment_breakdown(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*by).agg(*_breakdown())


def label_job_summary(labels: DataFrame, jobs: DataFrame) -> DataFrame:
    """One result row per label job (``job_id``, ``review_ids``). A job that found no review fails."""
    members = jobs.select("job_id", F.explode("review_ids").alias("review_id"))
    done = (
        members.join(labels, "review_id")
        .groupBy("job_id")
        .agg(F.count("*").alias("items_processed"), _average_confidence(), *_breakdown())
    )
    success = F.col("items_processed").isNotNull()
    first_ids = F.array_join(F.slice("review_ids", 1, 5), ", ")
    return jobs.join(done, "job_id", "left").select(
        "job_id",
        success.alias("success"),
        F.when(success, F.format_string(LABELED, "items_processed")).alias("message"),
        F.when(~success, F.format_string(NO_REVIEWS, first_ids)).alias("error"),
        F.when(~success, F.slice("review_ids", 1, 10)).alias("failed_review_ids"),
        F.coalesce("items_processed", F.lit(0)).alias("items_processed"),
        "average_confidence",
        *S.SENTIMENTS,
    )


def label_results(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """Result rows of label jobs: ``summary`` with the milliseconds each job took, or the error that ended it.

    ``runs`` has ``job_id, review_ids, started_at, finished_at`` and ``error`` (NULL: none), one row per job. A job that
    ended with an error has labeled nothing and reports the first ids it was given.
    """
    taken = F.unix_millis("finished_at") - F.unix_millis("started_at")
    ended = F.col("_error").isNull()
    reported = {
        "success": ended & F.coalesce("success", F.lit(False)),
        "message": F.when(ended, F.col("message")),
        "error": F.coalesce("_error", "error"),
        "failed_review_ids": F.when(ended, F.col("failed_review_ids")).otherwise(F.slice("review_ids", 1, 10)),
        "items_processed": F.when(ended, F.coalesce("items_processed", F.lit(0))).otherwise(0),
    }
    told = runs.select("job_id", "review_ids", taken.alias("processing_time"), F.col("error").alias("_error"))
    names = [name for name in summary.columns if name != "job_id"]
    return told.join(summary, "job_id", "left").select(
        "job_id",
        *[reported.get(name, F.when(ended, F.col(name))).alias(name) for name in names],
        "processing_time",
    )


def backlog_summary(labels: DataFrame) -> DataFrame:
    """The one-row result of a backlog run; an empty backlog is a success with 0 items."""
    n = F.col("items_processed")
    return labels.agg(F.count("*").alias("items_processed"), _average_confidence(), *_breakdown()).select(
        F.lit(True).alias("success"),
        F.when(n == 0, BACKLOG_EMPTY)
        .otherwise(F.format_string(BACKLOG_LABELED, n))
        .alias("message"),
        "items_processed",
        "average_confidence",
        *S.SENTIMENTS,
    )
