"""Job tables: status counts, health, metrics, recent jobs and retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.rounding import half_up
from echolens.operators.ordinals import first_per_group

# Limits of the health rules.
QUEUE_FAILED_LIMIT = 10
TOTAL_FAILED_LIMIT = 20
DEAD_LETTER_LIMIT = 50

FINISHED = ("completed", "failed")
BROADCAST_IDS = 100_000


def zero_fill_types(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Left join from the five job types; missing numbers become 0. ``df`` has one row per type."""
    types = S.job_type_dimension(df.sparkSession).withColumnRenamed("type", type_col)
    numbers = [name for name, kind in df.dtypes if kind in ("bigint", "int", "double")]
    joined = types.join(df, type_col, "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(0)) for name in numbers}) if numbers else joined


def resolve_job_options(jobs: DataFrame) -> DataFrame:
    """Explicit option, else the payload's value, else the default; zero counts as absent.

    Input columns: option_priority, option_delay, option_attempts and priority, delay, retry_attempts.
    """

    def first_nonzero(option: str, value: str, default: int) -> Column:
        return F.coalesce(F.nullif(F.col(option), F.lit(0)), F.nullif(F.col(value), F.lit(0)), F.lit(default))

    return jobs.withColumns(
        {
            "resolved_priority": first_nonzero("option_priority", "priority", S.DEFAULT_PRIORITY),
            "resolved_delay": first_nonzero("option_delay", "delay", S.DEFAULT_DELAY),
            "resolved_attempts": first_nonzero("option_attempts", "retry_attempts", S.DEFAULT_ATTEMPTS),
        }
    )


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs per type and state, one row for each of the five types."""
    counts = jobs.groupBy("type").agg(*[F.count_if(F.col("status") == state).alias(state) for state in S.JOB_STATES])
    return zero_fill_types(counts)


def result_stats(jobs: DataFrame) -> DataFrame:
    """Completed jobs per type by what their result says.

    A worker that fails inside its processor still completes its job, with ``success`` false in the result, so the
    status counts show it as completed. This table tells the two apart.
    """
    done = jobs.where(F.col("status") == "completed")
    success = F.coalesce(F.try_variant_get(F.try_parse_json("result"), "$.success", "boolean"), F.lit(False))
    counts = done.groupBy("type").agg(
        F.count("*").alias("completed"),
        F.count_if(success).alias("succeeded"),
        F.count_if(~success).alias("reported_failures"),
    )
    return zero_fill_types(counts)


def _over_types(column: Column) -> Column:
    """An aggregate over the five rows of a zero-filled table."""
    return column.over(Window.partitionBy())


def _with_dead_letters(stats: DataFrame, dlq: DataFrame) -> DataFrame:
    totals = dlq.groupBy(F.col("original_job_type").alias("type")).agg(F.count("*").alias("dlq_total"))
    return stats.join(totals, "type", "left").withColumn("dlq_total", F.coalesce("dlq_total", F.lit(0)))


def queue_health(jobs: DataFrame, dlq: DataFrame, connection: str = "healthy") -> DataFrame:
    """Health per type, with the overall status and totals repeated on each of the five rows."""
    link = F.lit(connection)
    failed, dead = F.col("total_failed"), F.col("total_dlq")
    return (
        _with_dead_letters(queue_stats(jobs), dlq)
        .withColumns(
            {
                "status": F.when(F.col("failed") > QUEUE_FAILED_LIMIT, "degraded").otherwise("healthy"),
                "total_active": _over_types(F.sum("active")),
                "total_waiting": _over_types(F.sum("waiting")),
                "total_failed": _over_types(F.sum("failed")),
                "total_dlq": _over_types(F.sum("dlq_total")),
            }
        )
        .withColumn(
            "overall_status",
            F.when((link == "unhealthy") | (dead > DEAD_LETTER_LIMIT), "unhealthy")
            .when((link == "degraded") | (failed > TOTAL_FAILED_LIMIT), "degraded")
            .otherwise("healthy"),
        )
    )


def queue_metrics(jobs: DataFrame, dlq: DataFrame) -> DataFrame:
    stats = _with_dead_letters(queue_stats(jobs), dlq)
    return stats.select(
        "type",
        *[F.col(state).alias(f"jobs_{state}") for state in S.JOB_STATES],
        "dlq_total",
        _over_types(F.sum("completed")).alias("total_jobs_processed"),
        _over_types(F.sum("failed")).alias("total_jobs_failed"),
        _over_types(F.sum("active")).alias("total_active_jobs"),
    )


def processing_stats(jobs: DataFrame, window_ms: int = 60_000, since: datetime | None = None) -> DataFrame:
    """Rates and load. As in the reference all-time totals are divided by the window, unless ``since`` is given."""
    counted = F.lit(True) if since is None else F.col("created_at") >= F.lit(since).cast("timestamp")

    def state(name: str, extra: Column | None = None) -> Column:
        hit = F.col("status") == name
        return hit if extra is None else hit & extra

    counts = jobs.groupBy("type").agg(
        F.count_if(state("completed", counted)).alias("completed"),
        F.count_if(state("failed", counted)).alias("failed"),
        F.count_if(state("active")).alias("active"),
        F.count_if(state("waiting")).alias("waiting"),
        F.min(F.when(state("waiting"), F.col("created_at"))).alias("oldest"),
    )
    finished = F.col("completed") + F.col("failed")
    return zero_fill_types(counts).select(
        "type",
        half_up(finished / F.lit(window_ms / 60_000)).alias("jobs_per_minute"),
        F.lit(0).alias("average_processing_time"),
        half_up(F.when(finished > 0, F.col("completed") / finished).otherwise(1.0), 2).alias("success_rate"),
        _over_types(F.sum("active")).alias("total_active_workers"),
        half_up(_over_types(F.sum("waiting")) / len(S.JOB_TYPES)).alias("average_queue_depth"),
        _over_types(F.min("oldest")).alias("oldest_waiting_job"),
    )


def oldest_waiting(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "waiting").agg(F.min("created_at").alias("oldest_waiting"))


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def recent_jobs(jobs: DataFrame, per_state: int = 5, n: int = 10) -> DataFrame:
    """Per type the newest ``n`` of the newest ``per_state`` active, completed and failed jobs."""
    shown = jobs.where(F.col("status").isin("active", "completed", "failed"))
    per = first_per_group(shown, ["type", "status"], _newest_first(), per_state, "_place").drop("_place")
    return first_per_group(per, ["type"], _newest_first(), n, "position")


def without_ids(df: DataFrame, removed: DataFrame, most: int, key: str = "id") -> DataFrame:
    """Rows of ``df`` not in ``removed``, which has at most ``most`` rows; broadcast only under a safe size."""
    ids = removed.select(key)
    return df.join(F.broadcast(ids) if most <= BROADCAST_IDS else ids, key, "left_anti")


def keep_last_finished(
    jobs: DataFrame, completed: int = 50, failed: int = 100, finished_col: str = "created_at"
) -> DataFrame:
    """Drop finished jobs beyond the newest ``completed`` and ``failed`` of each type; others stay."""
    is_finished = F.coalesce(F.col("status").isin(*FINISHED), F.lit(False))
    newest = [F.col(finished_col).desc(), F.col("id").desc()]
    quota = F.when(F.col("status") == "completed", completed).otherwise(failed)
    last = first_per_group(jobs.where(is_finished), ["type", "status"], newest, max(completed, failed), "_place")
    return jobs.where(~is_finished).unionByName(last.where(F.col("_place") <= quota).drop("_place"))


def clean_queue(
    jobs: DataFrame,
    as_of: datetime,
    grace_ms: int = 86_400_000,
    limit: int = 100,
    finished_col: str = "created_at",
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): finished jobs older than the grace time go, the oldest ``limit`` per type and state.

    A limit of 0 removes all of them.
    """
    cutoff = F.lit(as_of - timedelta(milliseconds=grace_ms)).cast("timestamp")
    old = F.col("status").isin(*FINISHED) & (F.col(finished_col) <= cutoff)
    if limit == 0:
        return jobs.where(~F.coalesce(old, F.lit(False))), jobs.where(old)
    oldest = [F.col(finished_col).asc(), F.col("id").asc()]
    removed = first_per_group(jobs.where(old), ["type", "status"], oldest, limit, "_place").drop("_place")
    return without_ids(jobs, removed, limit * len(S.JOB_TYPES) * len(FINISHED)), removed
