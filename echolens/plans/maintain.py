"""Stored reviews, labels and insights kept up to date batch by batch, by the parts that a batch touches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators.insights import fold_stats, insight_stats, stat_changes
from echolens.operators.merge import LABEL_UPDATES, REVIEW_UPDATES, merge_parts, part_of_key, with_label_ids
from echolens.operators.normalize import analyses_from_columns, labels_to_analyses
from echolens.session import store
from echolens.sources.versions import PART, Versions
from echolens.sources.writers import CSV_OPTIONS, LABEL_COLUMNS, labeled_reviews

#: Parts of a stored table; as many as keep one part at a few hundred megabytes.
PARTS = 256
STATS = (
    "theme string, mentions bigint, positive bigint, negative bigint, neutral bigint, severity_sum double, "
    "severity_count bigint, requests bigint, first_ord bigint, first_request_ord bigint"
)
LABELED_CSV = "labeled_csv"
_REVIEWS, _LABELS, _PARTIALS, _CHANGES = "reviews", "labels", "insight_parts", "insight_changes"


def put_reviews(tables: Versions, source: DataFrame, as_of: datetime, parts: int = PARTS) -> list[int]:
    """Upsert reviews into the parts that hold them; gives these parts."""
    run = tables.begin()
    touched = merge_parts(run, _REVIEWS, S.REVIEWS, source, "id", REVIEW_UPDATES, as_of, parts)
    run.publish()
    return touched


def put_labels(
    tables: Versions, source: DataFrame, as_of: datetime, parts: int = PARTS, reviews: DataFrame | None = None
) -> list[int]:
    """Upsert labels into the parts that hold them and renew the insight partials of these parts; gives them.

    A partial has the fixed width of ``insight_stats``, one row per part and theme. A relabel takes a review off its old
    theme by replacing the partials of its part, which also gives minima back that a signed delta could not. Labels,
    partials and the signed changes of the batch appear together, and with ``reviews`` given also the batch's part of the
    labeled-review CSV: the reviews it labels, with their labels as given.
    """
    source = store(source, "label-batch")
    run = tables.begin()
    touched = merge_parts(run, _LABELS, S.LABELS, with_label_ids(source), "review_id", LABEL_UPDATES, as_of, parts)
    labels = run.staged(_LABELS, S.LABELS, touched)
    dealt = labels.select("*", part_of_key("review_id", LABEL_UPDATES, parts), F.unix_micros("created_at").alias("ord"))
    analyses = analyses_from_columns(labels_to_analyses(dealt), PART)
    run.put(_PARTIALS, insight_stats(analyses, [PART]), touched)
    before, after = run.read(_PARTIALS, STATS, touched), run.staged(_PARTIALS, STATS, touched)
    run.append(_CHANGES, stat_changes(before, after))
    if reviews is not None:
        labeled = reviews.join(source.select(F.col("review_id").alias("id")), "id", "left_semi")
        run.append(LABELED_CSV, labeled_reviews(labeled, source), "csv", **CSV_OPTIONS)
    run.publish()
    return touched


def current(tables: Versions, name: str) -> DataFrame:
    """The stored ``reviews`` or ``labels``."""
    return tables.read(name, S.TABLES[name])


def maintained_stats(tables: Versions) -> DataFrame:
    """``insight_stats`` of all labels, folded from the partials: at most one row per part and theme is read."""
    return fold_stats(tables.read(_PARTIALS, STATS))


def insight_changes(tables: Versions) -> DataFrame:
    """Signed changes of all batches per theme; their sums are the counts of ``maintained_stats``."""
    counted = ", ".join(f for f in STATS.split(", ") if not f.startswith("first_"))
    return tables.read(_CHANGES, counted)


def labeled_csv(tables: Versions) -> DataFrame:
    """The labeled-review CSV of all published batches, columns as text under their titles."""
    titles = [title for _, title in S.REVIEW_CSV_HEADERS]
    schema = ", ".join(f"`{name}` string" for name in (*titles, *LABEL_COLUMNS))
    return tables.read(LABELED_CSV, schema, fmt="csv", **CSV_OPTIONS, multiLine="true")
