"""Picking reviews to label and cutting them into batches and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators.ordinals import with_position

PICK_ROWS = 100_000
NEWEST_FIRST = ("created_at", "id")


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").asc()]


def unlabeled_reviews(reviews: DataFrame, labels: DataFrame, limit: int | None = 100) -> DataFrame:
    """Reviews without a label, newest first. ``limit=None`` gives the whole backlog, unordered.

    For a small limit only ids and times go through the join and the top-k; the full rows of the at most
    ``limit`` winners are then fetched by a broadcast semi join, so no review text is shuffled.
    """
    done = labels.select(F.col("review_id").alias("id"))
    if limit is None:
        return reviews.join(done, "id", "left_anti")
    picked = reviews.select(*NEWEST_FIRST).join(done, "id", "left_anti").orderBy(*_newest_first()).limit(limit)
    if limit > PICK_ROWS:
        return reviews.join(picked.select("id"), "id", "left_semi").orderBy(*_newest_first())
    return reviews.join(F.broadcast(picked.select("id")), "id", "left_semi").orderBy(*_newest_first())


def skip_done(reviews: DataFrame, done: DataFrame, done_id: str = "id") -> DataFrame:
    """Resume: leave out reviews that an earlier output already holds."""
    return reviews.join(done.select(F.col(done_id).alias("id")), "id", "left_anti")


def reviews_by_ids(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Reviews whose id is in ``ids``, newest first. Catalyst broadcasts the ids when their size allows."""
    return reviews.join(ids.select("id"), "id", "left_semi").orderBy(*_newest_first())


def enrich_reviews(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Every review with its label columns; NULL where there is none."""
    wanted = ("theme", "sentiment", "severity", "feature_request", "direct_quote")
    return reviews.join(labels.select(F.col("review_id").alias("id"), *wanted), "id", "left")


def number_batches(
    df: DataFrame, order: Sequence[Column], size: int = S.DEFAULT_BATCH_SIZE, by: Sequence[str] = ()
) -> DataFrame:
    """Consecutive batches of ``size`` in input order: ``batch_no`` from 0 and ``position`` in it from 1."""
    numbered = with_position(df, order, by, name="_position")
    return numbered.withColumns(
        {
            "batch_no": F.floor((F.col("_position") - 1) / size),
            "position": (F.pmod(F.col("_position") - 1, F.lit(size)) + 1).cast("int"),
        }
    ).drop("_position")


def label_jobs(
    batches: DataFrame,
    by: Sequence[str] = (),
    size: int = S.DEFAULT_BATCH_SIZE,
    model: str = S.DEFAULT_LABEL_MODEL,
) -> DataFrame:
    """One label job per batch with its ids in order. A group never has more than one batch of rows."""
    return (
        batches.groupBy(*by, "batch_no")
        .agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_members"))
        .select(
            *by,
            "batch_no",
            F.col("_members.id").alias("review_ids"),
            F.lit(size).alias("batch_size"),
            F.lit(model).alias("model"),
            F.lit(None).cast("string").alias("correlation_id"),
            F.lit(S.DEFAULT_PRIORITY).alias("priority"),
            F.lit(2).alias("retry_attempts"),
            F.lit(S.DEFAULT_DELAY).alias("delay"),
        )
    )
