"""Global and per-group positions without sending a group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.session import null_safe_join, store

# Tasks are dealt into this many parts for the first round of a top-n per group.
_PARTS = 64
# Within this id, the upper 31 bits are the partition and the lower 33 the place inside it.
_PARTITION_SHIFT = 33


def with_position(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Add the 1-based place of each row in ``order``, counted within each ``by`` group when given.

    ``row_number`` would sort each group in one task. Here the rows are range-partitioned on group and order
    together, so a large group spreads over many tasks, and a row's place is its place inside the partition plus
    the number of rows of its group in earlier partitions. The sorted rows are written to the shared folder with
    their partition and place first: both uses below must see the same places, also after an executor is lost. Rows
    whose group is NULL form a group. ``order`` must be total for the result to be repeatable.
    """
    spread = [F.col(column) for column in by] + list(order)
    sorted_rows = df.repartitionByRange(*spread).sortWithinPartitions(*spread)
    placed = store(sorted_rows.withColumn("_slot", F.monotonically_increasing_id()), "positions")
    partition = F.shiftright("_slot", _PARTITION_SHIFT)
    pieces = placed.withColumn("_part", partition).groupBy(*by, "_part").agg(
        F.min("_slot").alias("_first"), F.count("*").alias("_rows")
    )
    # One row per group and partition it touches; a group touches at most as many as there are partitions.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    if not by:
        starts = F.broadcast(starts)  # at most one row per partition
    return (
        null_safe_join(placed.withColumn("_part", partition), starts, [*by, "_part"])
        .withColumn(name, F.col("_slot") - F.col("_first") + F.col("_before") + 1)
        .select(*df.columns, name)
    )


def first_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "position"
) -> DataFrame:
    """The first ``n`` rows of each group with their 1-based ``position``.

    Up to Spark's group-limit threshold each task keeps only its own first ``n`` rows per group before the shuffle.
    A first round ranks within (group, part of the tasks) and only its winners, at most ``n`` per part, meet in the
    second, so also with very many tasks no single one receives what all of them kept. The part decides nothing but
    the route of a row. Beyond the threshold the rows get distributed positions.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        return with_position(df, order, by, name).where(F.col(name) <= n)

    def first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where(F.col(name) <= n)

    parts = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))
    return first(first(parts, [*by, "_part"]).drop("_part", name), by)
