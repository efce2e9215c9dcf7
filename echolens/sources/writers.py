"""Review CSV, exports, job results and stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.text import iso_millis, sanitize_name
from echolens.operators.backlog import enrich_reviews

# Everything is quoted and nothing trimmed: review texts hold line breaks, quotes, commas and outer blanks.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "quoteAll": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
LABEL_COLUMNS = ("theme", "sentiment", "severity", "feature_request", "direct_quote")


def _titled_columns(reviews: DataFrame) -> list[Column]:
    timed = {name for name, kind in reviews.dtypes if kind == "timestamp"}
    return [
        (iso_millis(F.col(name)) if name in timed else F.col(name)).alias(title) for name, title in S.REVIEW_CSV_HEADERS
    ]


def titled_reviews(reviews: DataFrame) -> DataFrame:
    """The 13 review columns in their fixed order under their CSV titles, times as ISO text."""
    return reviews.select(*_titled_columns(reviews))


def write_reviews_csv(reviews: DataFrame, path: str) -> bool:
    """Write the review CSV; with no rows nothing is left at ``path`` and False returned.

    Taking the empty folder away needs a classic session; Spark Connect has no way to it.
    """
    counted = Observation()
    rows = titled_reviews(reviews).observe(counted, F.count(F.lit(1)).alias("rows"))
    # Rows are counted while they are written, in one run of the plan. The folder must not have been there before, so
    # what is taken away after a run without rows is only what this run made.
    rows.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)
    written = counted.get["rows"] > 0
    if not written:
        folder = reviews.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(reviews.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return written


def write_reviews_csv_by_app(reviews: DataFrame, apps: DataFrame, root: str) -> None:
    """One folder of CSV per app under ``root``, named ``app=`` and the app's sanitised title.

    Apps without a title, or unknown ones, go by the name of an unknown app; apps of one name share a folder.
    """
    titles = apps.select(F.col("id").alias("app_id"), F.col("title").alias("_title"))
    named = reviews.join(titles, "app_id", "left").withColumn(
        "app", sanitize_name(F.coalesce(F.nullif("_title", F.lit("")), F.lit(S.UNKNOWN_APP)))
    )
    named.select("app", *_titled_columns(named)).write.partitionBy("app").options(**CSV_OPTIONS).csv(root)


def labeled_reviews(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Titled review columns followed by the label columns."""
    enriched = enrich_reviews(reviews, labels)
    timed = {name for name, kind in enriched.dtypes if kind == "timestamp"}
    return enriched.select(
        *[
            (iso_millis(F.col(name)) if name in timed else F.col(name)).alias(title)
            for name, title in S.REVIEW_CSV_HEADERS
        ],
        *LABEL_COLUMNS,
    )


def append_labeled_csv(reviews: DataFrame, labels: DataFrame, path: str) -> None:
    """Append newly labeled reviews to a labeled-review CSV folder."""
    labeled_reviews(reviews, labels).write.mode("append").options(**CSV_OPTIONS).csv(path)


def export_reviews(
    reviews: DataFrame,
    labels: DataFrame,
    app_id: str,
    include_labels: bool = True,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Reviews of one app, optionally within an inclusive date range, with or without labels.

    The filters come before the join and reach the scan.
    """
    chosen = reviews.where(F.col("app_id") == app_id)
    if start is not None:
        chosen = chosen.where(F.col("date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        chosen = chosen.where(F.col("date") <= F.lit(end).cast("timestamp"))
    return enrich_reviews(chosen, labels) if include_labels else chosen


def run_export(reviews: DataFrame, labels: DataFrame, job: dict, path: str) -> None:
    """Write what an export job asks for: ``appId``, ``format`` (csv or json), ``includeLabels`` and ``dateRange``.

    The members and their defaults are those of the job's payload after validation.
    """
    dates = job.get("dateRange") or {}
    start, end = (datetime.fromisoformat(dates[name]) if name in dates else None for name in ("startDate", "endDate"))
    fmt = job.get("format", "csv")
    if fmt not in ("csv", "json"):
        raise ValueError(f"format is not supported: {fmt}")
    rows = export_reviews(reviews, labels, job["appId"], job.get("includeLabels", True), start, end)
    write_result(rows, path, fmt)


def write_result(df: DataFrame, path: str, fmt: str = "database") -> None:
    """Write a job result as csv, json, or a table (Parquet)."""
    if fmt == "csv":
        df.write.options(**CSV_OPTIONS).csv(path)
    elif fmt == "json":
        df.write.json(path)
    elif fmt == "database":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown output format: {fmt}")


def result_rows(reviews: DataFrame, labels: DataFrame, result_type: str) -> DataFrame:
    """What a result of a type consists of: the reviews of a crawl, labeled reviews, or an export with what labels it has.

    ``reviews`` and ``labels`` are those of the source job. Labeled reviews are the ones that have a label.
    """
    if result_type == "scraped_reviews":
        return titled_reviews(reviews)
    if result_type == "labeled_reviews":
        of = labels.select(F.col("review_id").alias("id"))
        return labeled_reviews(reviews.join(of, "id", "left_semi"), labels)
    if result_type == "exported_data":
        return enrich_reviews(reviews, labels)
    raise ValueError(f"result type is not supported: {result_type}")


def run_process_results(reviews: DataFrame, labels: DataFrame, job: dict, path: str) -> None:
    """Write the result that a job asks for: its ``resultType`` in its ``outputFormat`` (a table unless given)."""
    write_result(result_rows(reviews, labels, job["resultType"]), path, job.get("outputFormat", "database"))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Store a table bucketed and sorted by its key.

    Reviews bucketed by ``id`` and labels by ``review_id`` into the same number of buckets join without a shuffle,
    which the backlog, enrichment and merge joins would otherwise repeat on each run.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).mode("errorifexists").saveAsTable(table)


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", **options: str) -> None:
    """Store a table under a fresh root; an existing one is never overwritten while it may be being read."""
    writer = df.write.format(fmt).options(**options)
    if fmt == "jdbc":
        writer.option("dbtable", name).mode("append").save()
    else:
        writer.mode("errorifexists").save(f"{root}/{name}")
