"""Retries of dead letters as one step: the new jobs and the letters that remain appear together or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators.deadletter import DEFAULT_RETRY_JOBS, pick_by_reason, retried_jobs
from echolens.session import store
from echolens.sources.versions import Run, Versions, part_of

PARTS = 64
RETRIED = (
    "id string, type string, status string, payload string, priority int, delay int, attempts int, max_attempts int"
)
_LETTERS, _JOBS = "dead_letters", "retried_jobs"


def put_dead_letters(tables: Versions, letters: DataFrame, parts: int = PARTS) -> None:
    """Store the dead letters anew, dealt by their id."""
    run = tables.begin()
    run.put(_LETTERS, letters.select(*S.DEAD_LETTERS.fieldNames(), part_of(["id"], parts)))
    run.publish()


def _retry(run: Run, picked: DataFrame, priority: int | None, delay: int | None, parts: int) -> None:
    """Take ``picked`` off the parts that hold them, add their jobs, and publish both."""
    touched = [part for (part,) in picked.select(part_of(["id"], parts)).distinct().collect()]
    rest = run.read(_LETTERS, S.DEAD_LETTERS, touched).join(picked.select("id"), "id", "left_anti")
    run.append(_JOBS, retried_jobs(picked, priority, delay))
    run.put(_LETTERS, rest.select(*S.DEAD_LETTERS.fieldNames(), part_of(["id"], parts)), touched)
    run.publish()


def retry_letters(
    tables: Versions, ids: Sequence[str], priority: int | None = None, delay: int | None = None, parts: int = PARTS
) -> None:
    """Retry dead letters by id; only the parts of these ids are read and rewritten. A missing id is an error."""
    run = tables.begin()
    wanted = tables.spark.createDataFrame([(i,) for i in ids], "id string")
    touched = [part for (part,) in wanted.select(part_of(["id"], parts)).distinct().collect()]
    picked = store(run.read(_LETTERS, S.DEAD_LETTERS, touched).where(F.col("id").isin(*ids)), "picked")
    missing = set(ids) - {i for (i,) in picked.select("id").distinct().collect()}
    if missing:
        raise LookupError(f"dead letters not found: {sorted(missing)}")
    _retry(run, picked, priority, delay, parts)


def retry_reason(
    tables: Versions,
    job_type: str,
    reason: str,
    max_jobs: int = DEFAULT_RETRY_JOBS,
    priority: int | None = None,
    delay: int | None = None,
    parts: int = PARTS,
) -> None:
    """Retry the newest ``max_jobs`` dead letters with this reason; only the parts that hold them are rewritten."""
    run = tables.begin()
    picked = store(pick_by_reason(run.read(_LETTERS, S.DEAD_LETTERS), job_type, reason, max_jobs), "picked")
    _retry(run, picked, priority, delay, parts)


def dead_letters(tables: Versions) -> DataFrame:
    return tables.read(_LETTERS, S.DEAD_LETTERS)


def retried(tables: Versions) -> DataFrame:
    """The jobs of all published retries."""
    return tables.read(_JOBS, RETRIED)
