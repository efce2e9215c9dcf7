"""Upserts and referential integrity over immutable tables.

Every function but ``merge_parts`` returns the new table; the caller writes it to a fresh path.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolens.session import store
from echolens.sources.versions import PART, Run

REVIEW_UPDATES = ("score", "title", "text", "helpful_votes")
LABEL_UPDATES = (
    "sentiment", "confidence", "theme", "severity", "feature_request", "direct_quote", "model_version",
)
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def merge(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update_cols: Sequence[str],
    as_of: datetime,
    source_rows: int | None = None,
) -> DataFrame:
    """Insert new keys; on existing keys overwrite ``update_cols`` and stamp ``updated_at``.

    ``source`` must be unique by ``key``. ``source_rows`` is the row count of the source when the caller knows
    it, as a micro-batch does. Up to BROADCAST_ROWS rows and BROADCAST_BYTES bytes the target is then updated in
    place by a broadcast join, without a shuffle of the target; otherwise both sides meet in one full outer join, with
    the same result. A NULL key matches nothing.
    """
    stamp = F.lit(as_of).cast("timestamp")
    columns = target.columns
    timed = [name for name in ("created_at", "updated_at") if name in columns]
    incoming = source.select(
        *[
            F.col(name) if name in source.columns else F.lit(None).cast(target.schema[name].dataType).alias(name)
            for name in columns
            if name not in timed
        ]
    )
    if source_rows is not None and source_rows <= BROADCAST_ROWS and _bytes(incoming) <= BROADCAST_BYTES:
        return _merge_small(target, incoming, key, update_cols, stamp, timed)
    # Presence is a mark of its own: a stored row without a key matches nothing and stays as it is.
    old = target.withColumn("_there", F.lit(True)).alias("old")
    new = incoming.withColumn("_there", F.lit(True)).alias("new")
    is_new = F.col("old._there").isNull()
    matched = F.col("old._there") & F.col("new._there")

    def pick(name: str):
        if name == key:
            return F.coalesce(f"old.{key}", f"new.{key}")
        if name == "created_at":
            return F.when(is_new, stamp).otherwise(F.col("old.created_at"))
        if name == "updated_at":
            return F.when(is_new | matched, stamp).otherwise(F.col("old.updated_at"))
        if name in update_cols:
            return F.when(is_new | matched, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        return F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return joined.select(*[pick(name).alias(name) for name in columns])


def _bytes(df: DataFrame) -> int:
    """Bytes of the texts of a source of few rows, plus a little for each other value."""
    sizes = [F.octet_length(name) if kind == "string" else F.lit(16) for name, kind in df.dtypes]
    return df.select(sum((F.coalesce(size, F.lit(16)) for size in sizes), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0


def _merge_small(target, incoming, key, update_cols, stamp, timed) -> DataFrame:
    old, new = target.alias("old"), F.broadcast(incoming).alias("new")
    matched = F.col(f"new.{key}").isNotNull()
    changed = {name: F.col(f"new.{name}") for name in update_cols} | {"updated_at": stamp}
    updated = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "left").select(
        *[
            (F.when(matched, changed[name]).otherwise(F.col(f"old.{name}")) if name in changed else F.col(f"old.{name}"))
            .alias(name)
            for name in target.columns
        ]
    )
    # The keys already stored, found by a broadcast semi join and so never more than the source rows.
    stored = target.select(key).join(F.broadcast(incoming.select(key)), key, "left_semi")
    inserted = incoming.join(F.broadcast(stored), key, "left_anti").withColumns({name: stamp for name in timed})
    return updated.unionByName(inserted.select(*target.columns))


def part_of_key(key: str, others: Sequence[str], parts: int) -> Column:
    """The part of a row by its key. Rows without a key match nothing; they are spread by their other columns."""
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*others))
    return F.pmod(hashed, F.lit(parts)).alias(PART)


def merge_parts(
    run: Run,
    name: str,
    schema: T.StructType,
    source: DataFrame,
    key: str,
    update_cols: Sequence[str],
    as_of: datetime,
    parts: int,
) -> list[int]:
    """``merge`` into the parts of a stored table that hold the keys of ``source``; gives the parts touched.

    Other parts are neither listed, read nor written. The source is stored once, as its parts and its rows are needed.
    Nothing is visible before the run is published.
    """
    kinds = {field.name: field.dataType for field in schema.fields}
    # The stored types, so that a row has the same part before and after the merge.
    given = source.select(*[F.col(c).cast(kinds[c]).alias(c) for c in source.columns if c in kinds])
    given = given.withColumns({c: F.lit(None).cast(kinds[c]) for c in update_cols if c not in given.columns})
    source = store(given.select("*", part_of_key(key, update_cols, parts)), "upsert")
    sizes = {part: n for part, n in source.groupBy(PART).count().collect()}
    touched = sorted(sizes)
    merged = merge(run.read(name, schema, touched), source.drop(PART), key, update_cols, as_of, sum(sizes.values()))
    run.put(name, merged.select(*schema.fieldNames(), part_of_key(key, update_cols, parts)), touched)
    return touched


def upsert_reviews(target: DataFrame, source: DataFrame, as_of: datetime, source_rows: int | None = None) -> DataFrame:
    """A known review takes new score, title, text and votes; all its other columns keep the first value."""
    return merge(target, source, "id", REVIEW_UPDATES, as_of, source_rows)


def with_label_ids(labels: DataFrame) -> DataFrame:
    """Ids derived from the review, so that a replayed batch writes the same rows."""
    return labels.withColumn("id", F.concat(F.lit("label_"), F.sha2(F.col("review_id"), 256)))


def upsert_labels(target: DataFrame, source: DataFrame, as_of: datetime, source_rows: int | None = None) -> DataFrame:
    """One label per review; a relabel keeps id and creation time."""
    return merge(target, with_label_ids(source), "review_id", LABEL_UPDATES, as_of, source_rows)


def ensure_apps(target: DataFrame, source: DataFrame, as_of: datetime, order: Sequence[Column] = ()) -> DataFrame:
    """Insert unknown apps; a known app is left as it is, even when the source knows more.

    Of several rows of an app the first in ``order`` counts, ties and no order by the columns' values.
    """
    stamp = F.lit(as_of).cast("timestamp")
    others = [name for name in source.columns if name != "id"]
    ranked = F.struct(*[place.alias(f"_o{i}") for i, place in enumerate(order)], *others)
    first = source.groupBy("id").agg(F.min(ranked).alias("_first")).select("id", *[f"_first.{name}" for name in others])
    fresh = first.join(target.select("id"), "id", "left_anti")
    fresh = fresh.withColumns({"created_at": stamp, "updated_at": stamp})
    return target.unionByName(fresh.select(*target.columns))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose parent does not exist. A NULL foreign key refers to nothing and is allowed."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows that remain once the parents in ``deleted`` are gone."""
    return child.join(deleted.select(F.col(pk).alias(fk)), fk, "left_anti")
