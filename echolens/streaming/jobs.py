"""Continuous job status and quarantine of bad jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echolens.operators.deadletter import to_dead_letters
from echolens.operators.validate import validate_jobs
from echolens.sources.versions import PART, Run, Versions, part_of
from echolens.streaming.reviews import BATCH, STATE_PARTS, start_batches

#: Later states of a job, where two are told for one time.
COURSE = ("waiting", "delayed", "active", "failed", "completed")
JOB_STATE = (
    "id string, at timestamp, course int, status string, type string, known boolean, old_status string, old_type string"
)
COUNTS = "type string, status string, jobs bigint"
ACTIVITY = "type string, active bigint, waiting bigint, completed bigint, failed bigint"


def busy_types(counts: DataFrame) -> DataFrame:
    """Counts of the job types that are not idle; a type is idle when nothing waits and nothing is active."""
    per_state = [
        F.coalesce(F.sum(F.when(F.col("status") == state, F.col("jobs"))), F.lit(0)).alias(state)
        for state in ("active", "waiting", "completed", "failed")
    ]
    return counts.groupBy("type").agg(*per_state).where((F.col("active") > 0) | (F.col("waiting") > 0))


def _move_jobs(run: Run, told: DataFrame, parts: int) -> DataFrame:
    """Move the jobs that a batch tells about to their last states; what the counts per type and state change by.

    ``told`` has ``id, type, status`` and the time ``at``, any number of rows per job. Of the stored states only the parts
    of these jobs are read and written. A job that changes its state is added to the new count and taken off the old one.
    """
    course = F.coalesce(*[F.when(F.col("status") == name, F.lit(k)) for k, name in enumerate(COURSE)], F.lit(-1))
    arrived = told.where(F.col("id").isNotNull()).select(
        F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), course.alias("course"), "status", "type",
        F.lit(False).alias("known"),
    )
    dealt = part_of(["id"], parts)
    touched = [part for (part,) in arrived.select(dealt).distinct().collect()]
    before = run.read("jobs", JOB_STATE, touched).select("id", "at", "course", "status", "type", F.lit(True).alias("known"))
    state = F.struct("at", "course", "status", "type")
    folded = before.unionByName(arrived).groupBy("id").agg(
        F.max(state).alias("_now"), F.max(F.when(F.col("known"), state)).alias("_old")
    )
    run.put(
        "jobs",
        folded.select(
            "id", "_now.*", F.col("_old").isNotNull().alias("known"), F.col("_old.status").alias("old_status"),
            F.col("_old.type").alias("old_type"), dealt,
        ),
        touched,
    )
    moved = run.staged("jobs", JOB_STATE, touched)
    same = F.col("status").eqNullSafe(F.col("old_status")) & F.col("type").eqNullSafe(F.col("old_type"))
    one = F.lit(1).cast("bigint")
    added = F.struct("type", "status", one.alias("jobs"))
    taken = F.struct(F.col("old_type").alias("type"), F.col("old_status").alias("status"), (-one).alias("jobs"))
    changed = moved.where(~F.col("known") | ~same)
    changes = changed.select(F.explode(F.when(F.col("known"), F.array(added, taken)).otherwise(F.array(added))).alias("c")).select("c.*")
    # Nothing tells jobs without an id apart, so each row is one.
    return changes.unionByName(told.where(F.col("id").isNull()).select("type", "status", one.alias("jobs")))


def stream_queue_status(
    jobs: DataFrame,
    out_root: str,
    checkpoint: str,
    trigger: dict | None = None,
    order: str = "updated_at",
    parts: int = STATE_PARTS,
) -> StreamingQuery:
    """After each trigger (30 seconds by default) the number of jobs per type and last state.

    A job's last state is the one with the latest ``order`` time; of states told for one time, the later one in a job's
    course. The last states are a table in ``parts`` by job id. Each batch adds the changes it brings to the counts of the
    batch before, at most one row per type and state, and publishes states, counts, and the counts of the types that are
    not idle together. A batch that is repeated starts from the same states.
    """
    tables = Versions(jobs.sparkSession, out_root)
    told = jobs.select("id", "type", "status", F.col(order).alias("at"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for the parts it touches, for their states, and for jobs without an id
        try:
            run = tables.begin(batch_id)
            changes = _move_jobs(run, batch, parts)
            counts = run.read("counts", COUNTS).unionByName(changes).groupBy("type", "status").agg(F.sum("jobs").alias("jobs"))
            run.put("counts", counts.where("jobs <> 0").withColumn(PART, F.lit(0)))
            run.put("activity", busy_types(run.staged("counts", COUNTS)).withColumn(PART, F.lit(0)))
            run.publish()
        finally:
            batch.unpersist()

    return start_batches(told, each, checkpoint, trigger)


def queue_status(spark: SparkSession, out_root: str, version: int | None = None) -> DataFrame:
    """``type, status, jobs`` after a batch, by default the last one."""
    return Versions(spark, out_root).read("counts", COUNTS, version)


def queue_activity(spark: SparkSession, out_root: str, version: int | None = None) -> DataFrame:
    """``type, active, waiting, completed, failed`` of the types that were not idle after a batch."""
    return Versions(spark, out_root).read("activity", ACTIVITY, version)


def stream_quarantine(
    jobs: DataFrame, out_root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Accepted jobs to ``accepted``, jobs with broken rules to ``dead_letters``, in a folder per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once for each of the two outputs
        try:
            accepted, bad = validate_jobs(batch)
            accepted.write.mode("overwrite").parquet(f"{out_root}/accepted/{BATCH}={batch_id}")
            reasons = bad.withColumn("error_message", F.array_join("errors", "; "))
            letters = to_dead_letters(reasons, F.current_timestamp())
            letters.write.mode("overwrite").parquet(f"{out_root}/dead_letters/{BATCH}={batch_id}")
        finally:
            batch.unpersist()

    return start_batches(jobs, each, checkpoint, trigger)
