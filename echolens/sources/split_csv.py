"""Quoted CSV with line feeds in its texts, one large file read by several tasks.

Whether a line feed ends a record depends on all quotes before it. A file is read as lines in byte ranges; the parity of
the quotes of each range, summed over the ranges before it, says whether a range begins inside a quoted text. Then every
range cuts its own records, and only what reaches over the border of a range, one record each, is put together
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolens.session import store

# So many ranges are sent to all tasks (a row of three numbers and a path each); with more of them lines are dealt by range.
_SENT_RANGES = 100_000
_PIECE = "file string, range bigint, head boolean, ends boolean, whole boolean, record string"


def _cut(batches: Iterator) -> Iterator:
    """Records of each range; lines come in their order. What a range's first or last record lacks is told by flags."""
    import pyarrow as pa

    made: list[tuple] = []
    at, inside, begun, lines, first = None, False, False, [], False

    def piece(ends: bool) -> tuple:
        return (*at, first, ends, ends and not begun, "\n".join(lines))

    def written() -> pa.RecordBatch:
        names = ["file", "range", "head", "ends", "whole", "record"]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
        columns = list(zip(*made)) if made else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for file, start, began, odd, value in zip(*[batch.column(c).to_pylist() for c in ("file", "range", "begins", "odd", "value")]):
            if (file, start) != at:
                if lines:
                    made.append(piece(False))
                at, inside, begun, lines, first = (file, start), began, began, [], start == 0
            lines.append(value)
            inside ^= odd
            if not inside:
                made.append(piece(True))
                begun, lines, first = False, [], False
        if len(made) >= 10_000:
            yield written()
            made = []
    if lines:
        made.append(piece(False))
    yield written()


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of CSV files, each file's first one (its header) left out.

    Quotes are those of the format: around a value, doubled inside. A quote that is never closed takes the rest of its
    file. Records that are empty are left out.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(*where, (quotes % 2 == 1).alias("odd"), "value")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "range").agg(F.count_if("odd").alias("_odd"))
    begins = F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2 == 1
    ranges = store(ranges.select("file", "range", begins.alias("begins")), "csv-ranges")
    placed = lines.withColumn("_line", F.monotonically_increasing_id())
    if ranges.limit(_SENT_RANGES + 1).count() <= _SENT_RANGES:
        placed = placed.join(F.broadcast(ranges), ["file", "range"])
    else:
        placed = placed.join(ranges, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "_line")
    pieces = store(placed.select("file", "range", "begins", "odd", "value").mapInArrow(_cut, _PIECE), "csv-records")
    # The tail of a range, what ranges inside one text hold, and the head of the range that ends it: at most two a range.
    order = ["range", (~F.col("ends")).alias("_late")]
    earlier = Window.partitionBy("file").orderBy("range", ~F.col("ends")).rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.where(~F.col("whole")).withColumn("_no", F.coalesce(F.sum(F.col("ends").cast("int")).over(earlier), F.lit(0)))
    joined = parts.groupBy("file", "_no").agg(
        F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct(*order, "record"))).alias("_parts")
    )
    together = joined.select("head", F.array_join(F.col("_parts.record"), "\n").alias("record"))
    records = pieces.where("whole").select("head", "record").unionByName(together).where(~F.col("head"))
    ended = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return records.select(ended.alias("record")).where("record <> ''")
