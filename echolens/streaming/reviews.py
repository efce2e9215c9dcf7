"""Continuous ingest and labeling of reviews.

A micro-batch must not rewrite the stored table. It appends its outcome to a log, in a folder of its own, so
that a replayed batch replaces exactly what its first attempt wrote. ``current_reviews`` and ``current_labels``
fold the log into the table that upserting batch after batch would have given; writing that result to a fresh
root compacts it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echolens import schemas as S
from echolens.operators.crawl import LIST_KEY, advance_frontier, split_due
from echolens.operators.labeling import Labeler, label_reviews, split_unmatched
from echolens.operators.merge import LABEL_UPDATES, REVIEW_UPDATES, with_label_ids
from echolens.plans.collect import check_reviews, reviews_to_store
from echolens.plans.label import last_label_per_review
from echolens.session import store
from echolens.sources.readers import explode_pages, page_columns
from echolens.sources.versions import PART, Versions, part_of

REVIEW_LOG, LABEL_LOG, QUARANTINE = "review_log", "label_log", "review_quarantine"
PAGE_STATE, UNMATCHED = "page_state", "label_unmatched"
#: State of the crawled lists: how far each may be read; and the parts it is dealt into.
FRONTIER = T.StructType(
    [*[T.StructField(name, T.StringType()) for name in LIST_KEY], *[T.StructField(n, T.LongType()) for n in ("reached", "bad")]]
)
LABEL_STATE = "label_state"
UNANSWERED = "id string, text string, tries int"
STATE_PARTS = 16
# Entries of a compacted log, before those of the first batch.
COMPACT_FIRST, COMPACT_LAST = -2, -1
BATCH = "batch_id"
_STAMPS = ("created_at", "updated_at")


def _logged(schema: T.StructType) -> T.StructType:
    """A log entry: the table's columns, with the time of the batch instead of the two stamps."""
    fields = [field for field in schema.fields if field.name not in _STAMPS]
    return T.StructType([*fields, T.StructField("stored_at", T.TimestampType())])


def _append(df: DataFrame, root: str, name: str, batch_id: int, stamp: Column) -> None:
    wanted = [field.name for field in _logged(S.TABLES[name.removesuffix("_log") + "s"]).fields]
    df.withColumn("stored_at", stamp).select(*wanted).write.mode("overwrite").parquet(f"{root}/{name}/{BATCH}={batch_id}")


def _stamp(as_of: datetime | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def start_batches(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None,
    mode: str = "append",
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def _log_reviews(raw: DataFrame, table_root: str, batch_id: int, as_of: datetime | None, strict: bool) -> None:
    raw = raw.persist()  # read once for the accepted and once for the quarantined rows
    try:
        collected = check_reviews(raw, strict)
        _append(reviews_to_store(collected.accepted), table_root, REVIEW_LOG, batch_id, _stamp(as_of))
        collected.quarantined.write.mode("overwrite").parquet(f"{table_root}/{QUARANTINE}/{BATCH}={batch_id}")
    finally:
        raw.unpersist()


def ingest_raw(
    stream: DataFrame,
    table_root: str,
    checkpoint: str,
    trigger: dict | None = None,
    as_of: datetime | None = None,
    strict: bool = False,
) -> StreamingQuery:
    """Normalise, validate, deduplicate and log a stream of raw review rows; bad rows go to quarantine."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _log_reviews(batch, table_root, batch_id, as_of, strict)

    return start_batches(stream, each, checkpoint, trigger)


def stream_ingest(
    spark: SparkSession,
    in_path: str,
    table_root: str,
    checkpoint: str,
    trigger: dict | None = None,
    as_of: datetime | None = None,
    strict: bool = False,
) -> StreamingQuery:
    """Ingest landed page files as they arrive, with the early stop of the batch path.

    Each list has a frontier, the run of good pages from its first one, and waiting pages, which landed ahead of a gap.
    A batch moves the frontiers of the lists it touches; pages up to them, arrived or waiting, are due and ingested, so
    a batch reads its own pages and, of the touched parts of the state, frontiers and waiting pages, however many pages
    have passed before. Once all files are in, the reviews are those of the batch path. A page already ingested is not
    taken back by a bad copy that lands later; such a copy ends its list there.

    The state of a batch becomes visible after its reviews are logged. A batch that is repeated starts from the state
    before it and replaces what its first attempt wrote.
    """
    pages = page_columns(spark.readStream.schema(S.REVIEW_PAGE).json(in_path))
    state = Versions(spark, f"{table_root}/{PAGE_STATE}")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            run = state.begin(batch_id)
            dealt = part_of(LIST_KEY, STATE_PARTS)
            touched = [part for (part,) in batch.select(dealt).distinct().collect()]
            waiting = run.read("waiting", pages.schema, touched)
            moved = advance_frontier(run.read("frontier", FRONTIER, touched), waiting, batch)
            run.put("frontier", moved.select("*", dealt), touched)
            due, ahead = split_due(waiting.unionByName(batch), run.staged("frontier", FRONTIER, touched))
            _log_reviews(explode_pages(due), table_root, batch_id, as_of, strict)
            run.put("waiting", ahead.select("*", dealt), touched)
            run.publish()
        finally:
            batch.unpersist()

    return start_batches(pages, each, checkpoint, trigger)


def _fold(log: DataFrame, key: str, updates: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First batch decides the fixed columns, last batch the updated ones; combined in each task first."""
    fixed = [name for name in columns if name not in (key, *updates, *_STAMPS)]
    return (
        log.groupBy(key)
        .agg(
            F.min_by(F.struct(*fixed, F.col("stored_at").alias("created_at")), BATCH).alias("_first"),
            F.max_by(F.struct(*updates, F.col("stored_at").alias("updated_at")), BATCH).alias("_last"),
        )
        .select(key, "_first.*", "_last.*")
        .select(*columns)
    )


def _read_log(spark: SparkSession, table_root: str, name: str, schema: T.StructType) -> DataFrame:
    fields = [*_logged(schema).fields, T.StructField(BATCH, T.LongType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{table_root}/{name}")


def current_reviews(spark: SparkSession, table_root: str) -> DataFrame:
    log = _read_log(spark, table_root, REVIEW_LOG, S.REVIEWS)
    return _fold(log, "id", REVIEW_UPDATES, S.REVIEWS.fieldNames())


def current_labels(spark: SparkSession, table_root: str) -> DataFrame:
    log = _read_log(spark, table_root, LABEL_LOG, S.LABELS)
    return _fold(log, "review_id", LABEL_UPDATES, S.LABELS.fieldNames())


def compact_log(spark: SparkSession, table_root: str, out_root: str, name: str = REVIEW_LOG) -> None:
    """Write a log folded to two entries to the fresh ``out_root``, so that reads no longer grow with the batches.

    The first entry holds each row as first stored with its creation time, the second the row as last updated; folding
    them gives the table again, and batches logged to ``out_root`` later come after both.
    """
    current = current_reviews(spark, table_root) if name == REVIEW_LOG else current_labels(spark, table_root)
    _append(current, out_root, name, COMPACT_FIRST, F.col("created_at"))
    _append(current, out_root, name, COMPACT_LAST, F.col("updated_at"))


def stream_label(
    spark: SparkSession,
    table_root: str,
    checkpoint: str,
    taxonomy: dict | list,
    labeler: Labeler,
    batch_size: int = S.DEFAULT_BATCH_SIZE,
    model: str = S.DEFAULT_LABEL_MODEL,
    concurrency: int | None = None,
    trigger: dict | None = None,
    as_of: datetime | None = None,
    attempts: int = 3,
) -> StreamingQuery:
    """Label reviews as they enter the review log; those an earlier batch has asked about are left out.

    Which ids were met is a table in parts by id; a batch reads the ids in the parts it touches, and neither log. Of several
    entries of a review in one batch the last one is asked about. Reviews that a call left without an answer wait
    in a table of their own and are asked about with the next batches, ``attempts`` times in all. Answers nobody
    asked for count if the review log has their id, which is looked up for them alone; the others go to a
    quarantine folder of the batch. A batch that is repeated is labeled whole again and replaces its first attempt.
    """
    schema = T.StructType([*_logged(S.REVIEWS).fields, T.StructField(BATCH, T.LongType())])
    arriving = spark.readStream.schema(schema).parquet(f"{table_root}/{REVIEW_LOG}").select("id", "text", BATCH)
    state = Versions(spark, f"{table_root}/{LABEL_STATE}")

    def each(batch: DataFrame, batch_id: int) -> None:
        run = state.begin(batch_id)
        waiting = run.read("unanswered", UNANSWERED)
        dealt = part_of(["id"], STATE_PARTS)
        entered = batch.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("text", F.struct(BATCH, "text")).alias("text"))
        entered = store(entered, "stream-entered")
        touched = [part for (part,) in entered.select(dealt).distinct().collect()]
        met = run.read("met", "id string", touched)
        # Written once: the new reviews and the answers to them are read by several results.
        fresh = entered.join(met, "id", "left_anti").withColumn("tries", F.lit(0))
        asked = store(fresh.unionByName(waiting), "stream-asked")
        run.put("met", met.union(entered.select("id")).distinct().select("id", dealt), touched)
        answers = store(label_reviews(asked.drop("tries"), taxonomy, labeler, batch_size, model, concurrency), "stream-answers")
        own, strays = split_unmatched(answers, asked, answers.count())
        n_strays = strays.count()
        if n_strays:
            known = spark.read.schema(schema).parquet(f"{table_root}/{REVIEW_LOG}").select("id")
            matched, strays = split_unmatched(strays, known, n_strays)
            own = own.unionByName(matched)
        _append(with_label_ids(last_label_per_review(own)), table_root, LABEL_LOG, batch_id, _stamp(as_of))
        strays.drop("answer_ord").write.mode("overwrite").parquet(f"{table_root}/{UNMATCHED}/{BATCH}={batch_id}")
        left = asked.join(answers.select(F.col("review_id").alias("id")).distinct(), "id", "left_anti")
        left = left.withColumn("tries", F.col("tries") + 1).where(F.col("tries") < attempts)
        run.put("unanswered", left.withColumn(PART, F.pmod(F.xxhash64("id"), F.lit(STATE_PARTS))))
        run.publish()

    return start_batches(arriving, each, checkpoint, trigger)


def stream_dedup(stream: DataFrame, time_col: str, watermark: str) -> DataFrame:
    """Drop repeated ids that arrive within the watermark. The first one wins, unlike in the batch dedup."""
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["id"])
