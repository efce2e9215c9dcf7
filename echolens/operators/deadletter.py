"""Dead letters: capture, inspection, retry and retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.coercion import text_or
from echolens.operators.jobs import BROADCAST_IDS, FINISHED, queue_stats, recent_jobs, without_ids, zero_fill_types
from echolens.operators.ordinals import first_per_group, with_position

DEFAULT_RETRY_JOBS = 10
UNKNOWN_REASON = "Unknown"


def to_dead_letters(failed: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Wrap failed jobs. ``as_of`` is the failure time of the batch, or a column when each job has its own."""
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of)

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in failed.columns else F.lit(None)).cast(kind)

    return failed.select(
        F.concat(F.lit("dlq_"), F.col("id").cast("string")).alias("id"),
        optional("payload", "string").alias("original_job_data"),
        F.col("id").cast("string").alias("original_job_id"),
        F.col("type").alias("original_job_type"),
        optional("error_message", "string").alias("failure_reason"),
        optional("error_stack", "string").alias("failure_stack"),
        stamp.cast("timestamp").alias("failed_at"),
        optional("attempts", "int").alias("attempts_made"),
        optional("processed_at", "timestamp").alias("processed_on"),
        optional("finished_at", "timestamp").alias("finished_on"),
        F.lit("waiting").alias("status"),
    )


def _newest_first() -> list[Column]:
    return [F.col("failed_at").desc(), F.col("id").desc()]


def dlq_reasons(dlq: DataFrame) -> DataFrame:
    """Dead letters per type and reason; reasons are free text, so they stay rows."""
    return dlq.groupBy(
        F.col("original_job_type").alias("type"),
        text_or(F.col("failure_reason"), UNKNOWN_REASON).alias("failure_reason"),
    ).agg(F.count("*").alias("jobs"))


def dlq_stats(dlq: DataFrame) -> DataFrame:
    """Per type: total, oldest and newest failure, with a row for each of the five types."""
    return zero_fill_types(
        dlq.groupBy(F.col("original_job_type").alias("type")).agg(
            F.count("*").alias("total"),
            F.min("failed_at").alias("oldest_failure"),
            F.max("failed_at").alias("newest_failure"),
        )
    )


def recent_dead_letters(dlq: DataFrame, n: int = 5) -> DataFrame:
    return first_per_group(dlq, ["original_job_type"], _newest_first(), n)


def dead_letter_page(dlq: DataFrame, start: int = 0, end: int = 99) -> DataFrame:
    """Rows ``start`` to ``end`` (both counted from 0, inclusive) of each type, newest first; end -1 means all."""
    if end < 0:
        numbered = with_position(dlq, _newest_first(), ["original_job_type"])
        return numbered.where(F.col("position") > start)
    return first_per_group(dlq, ["original_job_type"], _newest_first(), end + 1).where(F.col("position") > start)


def dlq_overview(dlq: DataFrame, n: int = 5) -> DataFrame:
    """``dlq_stats`` plus the ``n`` newest entries per type in one array."""
    newest = (
        recent_dead_letters(dlq, n)
        .groupBy(F.col("original_job_type").alias("type"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "position",
                        "id",
                        text_or(F.col("failure_reason"), UNKNOWN_REASON).alias("failure_reason"),
                        "failed_at",
                        "original_job_type",
                    )
                )
            ).alias("recent_jobs")
        )
    )
    return dlq_stats(dlq).join(newest, "type", "left")


def queue_details(jobs: DataFrame, dlq: DataFrame, n: int = 5) -> DataFrame:
    """One row per type: job counts, the newest jobs, and its dead letters by reason with the newest failures.

    The newest jobs (ten of the newest ``n`` active, completed and failed ones) carry their times and the reason they
    failed for, as far as ``jobs`` has those columns.
    """
    wanted = [name for name in ("created_at", "processed_at", "finished_at", "error_message") if name in jobs.columns]
    newest = (
        recent_jobs(jobs, n)
        .groupBy("type")
        .agg(F.array_sort(F.collect_list(F.struct("position", "id", "status", *wanted))).alias("recent_jobs"))
    )
    reasons = dlq_reasons(dlq).groupBy("type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure_reason", "jobs")))).alias("by_failure_reason")
    )
    failures = dlq_overview(dlq, n).select(
        "type", F.col("total").alias("dlq_total"), F.col("recent_jobs").alias("recent_failures")
    )
    counted = queue_stats(jobs)
    return counted.join(newest, "type", "left").join(reasons, "type", "left").join(failures, "type", "left")


def retried_jobs(picked: DataFrame, priority: int | None = None, delay: int | None = None) -> DataFrame:
    """New jobs for dead letters, with ids of their own that a repeated retry gives again."""
    return picked.select(
        F.concat(F.lit("retry_"), F.col("original_job_id")).alias("id"),
        F.col("original_job_type").alias("type"),
        F.lit("waiting").alias("status"),
        F.col("original_job_data").alias("payload"),
        F.lit(priority or S.DEFAULT_PRIORITY).alias("priority"),
        F.lit(delay or S.DEFAULT_DELAY).alias("delay"),
        F.lit(0).alias("attempts"),
        F.lit(S.DEFAULT_ATTEMPTS).alias("max_attempts"),
    )


def retry_dead_letter(
    dlq: DataFrame, ids: Sequence[str], priority: int | None = None, delay: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new jobs, remaining dead letters). An id that is not there is an error."""
    picked = dlq.where(F.col("id").isin(*ids))
    missing = set(ids) - {row["id"] for row in picked.select("id").distinct().limit(len(ids)).toLocalIterator()}
    if missing:
        raise LookupError(f"dead letters not found: {sorted(missing)}")
    return retried_jobs(picked, priority, delay), dlq.where(~F.col("id").isin(*ids))


def pick_by_reason(dlq: DataFrame, job_type: str, reason: str, max_jobs: int = DEFAULT_RETRY_JOBS) -> DataFrame:
    """The newest ``max_jobs`` dead letters of a type with exactly this reason; 0 means 10."""
    matching = dlq.where((F.col("original_job_type") == job_type) & (F.col("failure_reason") == reason))
    return matching.orderBy(*_newest_first()).limit(max_jobs or DEFAULT_RETRY_JOBS)


def retry_by_reason(
    dlq: DataFrame,
    job_type: str,
    reason: str,
    max_jobs: int = DEFAULT_RETRY_JOBS,
    priority: int | None = None,
    delay: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new jobs, remaining dead letters) for the newest ``max_jobs`` with exactly this reason; 0 means 10."""
    picked = pick_by_reason(dlq, job_type, reason, max_jobs)
    known = min(max_jobs or DEFAULT_RETRY_JOBS, BROADCAST_IDS + 1)
    return retried_jobs(picked, priority, delay), without_ids(dlq, picked, known)


def _split_old(df: DataFrame, old: Column) -> tuple[DataFrame, DataFrame]:
    gone = F.coalesce(old, F.lit(False))
    return df.where(~gone), df.where(gone)


def clean_dead_letters(dlq: DataFrame, as_of: datetime, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): completed and failed entries older than ``days`` go."""
    cutoff = F.lit(as_of - timedelta(days=days)).cast("timestamp")
    return _split_old(dlq, F.col("status").isin(*FINISHED) & (F.col("failed_at") <= cutoff))


def run_cleanup(
    target: str, reviews: DataFrame, jobs: DataFrame, as_of: datetime, days: int = 30, dry_run: bool = False
) -> DataFrame:
    """Clean-up by the target of its job: reviews, or failed jobs, older than ``days``.

    Gives the rows that stay, of a dry run those that would go. Only failed jobs go; a job of another state stays
    whatever its age.
    """
    if target == "old_reviews":
        return cleanup(reviews, "date", as_of, days, dry_run)
    if target == "failed_jobs":
        old = F.col("created_at") < F.lit(as_of - timedelta(days=days)).cast("timestamp")
        kept, gone = _split_old(jobs, (F.col("status") == "failed") & old)
        return gone if dry_run else kept
    raise ValueError(f"clean-up target is not supported: {target}")


def cleanup(df: DataFrame, ts_col: str, as_of: datetime, days: int = 30, dry_run: bool = False) -> DataFrame:
    """What is left after rows older than ``days`` are dropped; a dry run returns the rows that would go."""
    cutoff = F.lit(as_of - timedelta(days=days)).cast("timestamp")
    kept, gone = _split_old(df, F.col(ts_col) < cutoff)
    return gone if dry_run else kept
