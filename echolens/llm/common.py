"""Row identities, stored intermediates and distributed positions shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence
from typing import Any
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolens.session import shared_folder

#: Two long columns that name a row and stay the same however often the plan is evaluated.
ROW_KEY = ("__row_file", "__row_number")
#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
# A group is dealt into blocks of about this many rows when its rows are numbered.
_BLOCK_ROWS = 20_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back; this cuts the lineage.

    Lost executors cost nothing here: the files are outside of them.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add two long columns (``ROW_KEY``) that name each row and do not change when ``df`` is computed again.

    Rows read from files are named by file and place in it. Other frames have no stable names, so they are numbered
    and stored first. Rows that are equal in all columns still get names of their own. A frame that has the columns
    already is returned as it is.
    """
    file, row = ROW_KEY
    if set(ROW_KEY) <= set(df.columns):
        return df
    try:
        return df.select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.xxhash64("_metadata.file_path").alias(file),
            F.col("_metadata.row_index").alias(row),
        )
    except AnalysisException:
        numbered = df.withColumn(file, F.lit(0).cast("long")).withColumn(row, F.monotonically_increasing_id())
        return stored(numbered, "rows")


def n_words(text: Column) -> Column:
    """Number of words in ``text`` (null: none), without building them."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{BLANK[:-1]}*{WORD}{BLANK[:-1]}*", "w")
    return F.when(F.startswith(marks, F.lit("w")), F.length(marks)).otherwise(0).cast("long")


def gapless(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, spread: Column) -> DataFrame:
    """Number the rows of each group from 0 without a gap, without bringing a large group into one task.

    A group is dealt into blocks of about 20,000 rows by ``spread`` (a long that does not depend on the route of a
    row). Block sizes give each block its first number, and only the rows of one block are sorted together. Groups
    may be null. ``order`` orders the rows of a block and must be total for the result to be repeatable.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups] + [F.col(g).isNull() for g in groups]
    rows = df.withColumn("_group", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    # Stored, so that the join deals both sides out itself and Spark may split a large group there.
    blocks = rows.groupBy("_group").agg(F.ceil(F.count("*") / _BLOCK_ROWS).cast("long").alias("_blocks"))
    blocks = stored(blocks, "blocks")
    dealt = rows.join(blocks, "_group").withColumn("_block", F.pmod(spread, F.col("_blocks")))
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("_group", "_block")
        .agg(F.count("*").alias("_n"))
        .select("_group", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy("_group", "_block").orderBy(*order))
    numbered = dealt.withColumn("_place", place).join(starts, ["_group", "_block"])
    return numbered.withColumn(name, F.col("_start") + F.col("_place") - 1).select(*df.columns, name)


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """An object that lives as long as its worker process, such as a loaded vocabulary.

    Functions of this package travel to the workers by value, so their own module variables are new in each task.
    """
    holder = sys.modules.setdefault("_echolens_worker", types.ModuleType("_echolens_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
