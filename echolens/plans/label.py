"""Label the reviews that have no label yet."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators.backlog import unlabeled_reviews
from echolens.operators.insights import backlog_summary
from echolens.operators.labeling import Labeler, call_labeler, labels_from_responses, split_unmatched, theme_names
from echolens.operators.merge import upsert_labels
from echolens.operators.normalize import restrict_to_taxonomy
from echolens.session import materialize, store


class BacklogRun(NamedTuple):
    labels: DataFrame
    summary: DataFrame
    unmatched: DataFrame


def last_label_per_review(labels: DataFrame) -> DataFrame:
    """One label per review: the last element that names it. Model answers may repeat a review."""
    others = [name for name in labels.columns if name not in ("review_id", "answer_ord")]
    return (
        labels.groupBy("review_id")
        .agg(F.max_by(F.struct(*others), "answer_ord").alias("_label"))
        .select("review_id", "_label.*")
    )


def label_backlog(
    reviews: DataFrame,
    labels: DataFrame,
    taxonomy: dict | list,
    labeler: Labeler,
    as_of: datetime,
    limit: int | None = 100,
    batch_size: int = S.DEFAULT_BATCH_SIZE,
    model: str = S.DEFAULT_LABEL_MODEL,
    concurrency: int | None = None,
    strict: bool = False,
) -> BacklogRun:
    """New label table, one-row summary, and labels for unknown reviews.

    The responses are written to the shared folder once: three results read them, and neither another read nor
    a lost executor may repeat calls that were already answered and written.
    """
    backlog = unlabeled_reviews(reviews, labels, limit)
    responses = materialize(call_labeler(backlog, taxonomy, labeler, batch_size, concurrency))
    fresh = labels_from_responses(responses, model)
    if strict:
        fresh = restrict_to_taxonomy(fresh, theme_names(taxonomy))
    # With a limit the new labels are few: parsed and counted once, they need not shuffle the tables.
    rows = None
    if limit is not None:
        fresh = store(fresh, "answers")
        rows = fresh.count()
    matched, unmatched = split_unmatched(fresh, reviews, rows)
    new = last_label_per_review(matched)
    merged = upsert_labels(labels, new if limit is None else store(new, "labels"), as_of, rows)
    return BacklogRun(merged, backlog_summary(fresh), unmatched)
