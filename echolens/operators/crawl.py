"""Crawl requests, early stop and deduplication of landed review pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators.normalize import normalize_apps
from echolens.session import null_safe_join

# Fixed value: message of the result of a crawl job.
CRAWLED = "Successfully scraped %d unique reviews for app %s"
LIST_KEY = ("app_id", "country_code", "sort_method")
CRAWL_ORDER = ("sort_ord", "country_ord", "page", "pos")


def crawl_jobs(
    apps: DataFrame,
    countries: Sequence[str] = S.DEFAULT_COUNTRIES,
    pages: int = S.DEFAULT_PAGES,
    sort_methods: Sequence[str] = ("recent",),
    throttle_ms: int = S.DEFAULT_THROTTLE_MS,
) -> DataFrame:
    """One crawl job per row of ``apps`` (column ``app_id``, other columns pass through)."""
    return apps.withColumns(
        {
            "countries": F.array(*[F.lit(code) for code in countries]),
            "pages": F.lit(pages),
            "sort_methods": F.array(*[F.lit(name) for name in sort_methods]),
            "throttle_ms": F.lit(throttle_ms),
            "correlation_id": F.lit(None).cast("string"),
            "priority": F.lit(S.DEFAULT_PRIORITY),
            "retry_attempts": F.lit(S.DEFAULT_ATTEMPTS),
            "delay": F.lit(S.DEFAULT_DELAY),
        }
    )


def crawl_plan(jobs: DataFrame, max_pages: int = S.MAX_PAGES) -> DataFrame:
    """One row per page to fetch, at most ``max_pages`` per list whatever the job asks for.

    Sort order is the outer loop, country the inner one, then the page.
    """
    return (
        jobs.select("app_id", "countries", "pages", F.posexplode("sort_methods").alias("sort_ord", "sort_method"))
        .select(
            "app_id", "pages", "sort_ord", "sort_method", F.posexplode("countries").alias("country_ord", "country_code")
        )
        .withColumn("page", F.explode(F.sequence(F.lit(1), F.least(F.col("pages"), F.lit(max_pages)))))
        .drop("pages")
    )


def apply_early_stop(pages: DataFrame) -> DataFrame:
    """Keep the pages of each (app, country, sort) list that come before the first empty, failed or missing one.

    ``pages`` has the list key, ``page`` (from 1), ``n_reviews`` and ``error``; lists may be of any length, and a page
    that landed twice is good if all its records are. Page numbers are combined per list before the shuffle, and page
    contents take no part. A list stops at the least page that follows a good one and is not good itself, which an
    anti join of the good pages with their successors gives without gathering a list.
    """
    counted = pages.where(F.col("page") >= 1).groupBy(*LIST_KEY, "page").agg(F.min(_good_page()).alias("_good"))
    good_pages = counted.where("_good").select(*LIST_KEY, "page")
    started = good_pages.where("page = 1").select(*LIST_KEY)
    following = good_pages.withColumn("page", F.col("page") + 1)
    stops = (
        null_safe_join(following, good_pages, [*LIST_KEY, "page"], "left_anti")
        .groupBy(*LIST_KEY)
        .agg(F.min("page").alias("_stop"))
    )
    stops = null_safe_join(stops, started, LIST_KEY, "left_semi")
    kept = null_safe_join(pages.where(F.col("page") >= 1), stops, LIST_KEY)
    return kept.where(F.col("page") < F.col("_stop")).drop("_stop")


def _good_page() -> Column:
    return (F.col("n_reviews") > 0) & F.col("error").isNull()


def advance_frontier(frontier: DataFrame, waiting: DataFrame, arrived: DataFrame) -> DataFrame:
    """How far lists may be read once ``arrived`` pages have landed: the list key, ``reached`` and ``bad``.

    ``reached`` is the last page of the run of good pages from page 1, 0 if there is none, and ``bad`` the least page with
    an empty or failed copy, NULL if there is none; neither ever goes back. ``frontier`` holds the lists known so far and
    ``waiting`` their good pages beyond ``reached``. Only page numbers take part: as in ``apply_early_stop`` the end of a
    run is the least page that follows a good one and is not there itself.
    """
    numbered = arrived.where(F.col("page") >= 1).withColumn("page", F.col("page").cast("long"))
    told = numbered.select(*LIST_KEY, F.lit(0).cast("long").alias("reached"), F.when(~_good_page(), F.col("page")).alias("bad"))
    known = (
        frontier.select(*LIST_KEY, "reached", "bad").unionByName(told).groupBy(*LIST_KEY)
        .agg(F.max("reached").alias("reached"), F.min("bad").alias("bad"))
    )
    there = (
        waiting.select(*LIST_KEY, F.col("page").cast("long").alias("page"))
        .unionByName(numbered.where(_good_page()).select(*LIST_KEY, "page"))
        .unionByName(known.select(*LIST_KEY, F.col("reached").alias("page")))
    )
    missing = null_safe_join(there.withColumn("page", F.col("page") + 1), there, [*LIST_KEY, "page"], "left_anti")
    # Pages up to the end of the run may be told again without all that follow them; what is missing there does not count.
    ends = null_safe_join(missing, known, LIST_KEY).where(F.col("page") > F.col("reached"))
    return ends.groupBy(*LIST_KEY).agg((F.min("page") - 1).alias("reached"), F.min("bad").alias("bad"))


def split_due(pages: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that are due, good pages that wait for a gap before them). Pages from the first bad one on are never due."""
    placed = null_safe_join(pages.where((F.col("page") >= 1) & _good_page()), frontier, LIST_KEY)
    before_bad = F.coalesce(F.col("page") < F.col("bad"), F.lit(True))
    due = placed.where((F.col("page") <= F.col("reached")) & before_bad).select(*pages.columns)
    return due, placed.where((F.col("page") > F.col("reached")) & before_bad).select(*pages.columns)


def _order(columns: Sequence[str]) -> Column:
    return F.struct(*columns)


def dedup_reviews(raw: DataFrame, order: Sequence[str] = CRAWL_ORDER) -> DataFrame:
    """Keep the last write of each (app_id, id) in crawl order.

    An aggregation, not a window: each task first reduces its own copies, so a review that makes up a large
    share of the rows reaches the final stage as one row per task. ``first_seen_*`` keeps the place at which
    the id was first met, which is the output order of the reference.
    """
    first_seen = [F.col(f"_first.{name}").alias(f"first_seen_{name}") for name in order]
    others = [name for name in raw.columns if name not in ("app_id", "id")]
    return (
        raw.groupBy("app_id", "id")
        .agg(
            F.max_by(F.struct(*others), _order(order)).alias("_last"),
            F.min(_order(order)).alias("_first"),
        )
        .select("app_id", "id", "_last.*", *first_seen)
    )


def fold_versions(
    raw: DataFrame,
    key: str,
    group: Sequence[str],
    order: Sequence[str],
    mutable: Sequence[str],
    fixed: Sequence[str],
) -> DataFrame:
    """One row per key, as if the groups (such as app jobs) had been stored one after the other.

    Within a group the last write wins. Across groups the fixed columns stay as the first group stored them and
    the mutable ones are those of the last group. Groups order ascending. One aggregation gives both.
    """
    negated = [(-F.col(name)).alias(f"_neg_{name}") for name in group]
    first_group_last_write = F.struct(*negated, *order)
    last_group_last_write = F.struct(*group, *order)
    return (
        raw.groupBy(key)
        .agg(
            F.max_by(F.struct(*fixed), first_group_last_write).alias("_fixed"),
            F.max_by(F.struct(*mutable), last_group_last_write).alias("_mutable"),
        )
        .select(key, "_fixed.*", "_mutable.*")
    )


def crawl_results(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """Result rows of crawl jobs: ``summary`` for those that ended well, else the error; with the time they took.

    ``runs`` has ``app_id, started_at, finished_at`` and ``error`` (NULL: none), one row per job; processing time is
    in milliseconds.
    """
    taken = F.unix_millis("finished_at") - F.unix_millis("started_at")
    ended = F.col("error").isNull()
    names = [name for name in summary.columns if name not in ("app_id", "success", "reviews_scraped")]
    return runs.join(summary.drop("success"), "app_id", "left").select(
        "app_id", ended.alias("success"), *[F.when(ended, F.col(name)).alias(name) for name in names],
        F.when(~ended, F.col("error")).alias("error"), taken.alias("processing_time"),
        F.when(ended, F.coalesce("reviews_scraped", F.lit(0))).otherwise(0).alias("items_processed"),
    )


def crawl_summary(reviews: DataFrame, plan: DataFrame, apps: DataFrame) -> DataFrame:
    """Per app: unique reviews, countries, sort orders and title. Apps without reviews report zero."""
    counts = reviews.groupBy("app_id").agg(F.count("*").alias("reviews_scraped"))
    asked = plan.groupBy("app_id").agg(
        F.size(F.collect_set("country_ord")).alias("countries_processed"),
        F.size(F.collect_set("sort_ord")).alias("sort_methods_used"),
    )
    titles = normalize_apps(asked.select(F.col("app_id").alias("id")), apps).select(
        F.col("id").alias("app_id"), F.col("title").alias("app_title")
    )
    return (
        asked.join(counts, "app_id", "left")
        .join(titles, "app_id", "left")
        .select(
            "app_id",
            "app_title",
            F.coalesce("reviews_scraped", F.lit(0)).alias("reviews_scraped"),
            "countries_processed",
            "sort_methods_used",
            F.lit(True).alias("success"),
            F.format_string(
                CRAWLED, F.coalesce("reviews_scraped", F.lit(0)), "app_id"
            ).alias("message"),
        )
    )
