"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import ROW_KEY, stored, with_row_key

# What makes two texts one: the digest, and as its check the byte length and an independent hash.
_TEXT_KEY = ("_digest", "_bytes", "_check")


def _identity(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [
        F.unhex(F.sha2(whole, 256)).alias("_digest"),
        F.octet_length(whole).alias("_bytes"),
        F.xxhash64(whole).alias("_check"),
    ]


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per distinct text with the row that stays (``_keep``) and the number of rows (``_size``).

    ``rows`` holds ``_run``, the text key, ``_id`` and the row key. A run is what one task has read, reduced to one
    entry per text. Each round merges the runs whose numbers agree but for the last factor of ``fan_in`` (a binomial
    tree taken log2(fan_in) levels at a time) and keeps, of the entries with equal and verified digests, the one with
    the largest id. The maximum of a struct is folded over input sorted by run and digest, so a round is a merge of
    sorted runs with constant memory. A text that fills a third of the table arrives as one entry per run.
    """
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    entry = F.struct("_id", *ROW_KEY)
    merged = rows.groupBy("_run", *_TEXT_KEY).agg(F.max(entry).alias("_keep"), F.count("*").alias("_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = (
            merged.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
            .groupBy("_run", *_TEXT_KEY)
            .agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
        )
    return merged.drop("_run")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256`` and the row key.

    Texts are equal when they are identical; null counts as empty, so null and empty texts form one group. Of equal
    texts the row with the largest id stays (a null id only if all are null); of rows that repeat an id and its
    text, the one with the largest row key. Exactly one row of each group is kept. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    rows = stored(
        with_row_key(docs).select(
            F.col(id_col).alias("_id"), *ROW_KEY, *_identity(F.col(text_col)), F.spark_partition_id().alias("_run")
        ),
        "digests",
    )
    # Stored, so that the join deals both sides out itself and Spark may split a text that many rows share.
    classes = stored(merge_runs(rows, fan_in), "classes")
    same_row = F.lit(True)
    for name in ROW_KEY:
        same_row = same_row & (F.col(f"_keep.{name}") == F.col(name))
    return rows.join(classes, list(_TEXT_KEY)).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        same_row.alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        *ROW_KEY,
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_copies`` drops, all columns and texts as they are.

    Only the names of dropped rows meet the texts, in an anti join on the row key, which no hot text can skew.
    """
    keyed = with_row_key(docs)
    dropped = exact_copies(keyed, id_col, text_col).where(~F.col("kept")).select(*ROW_KEY)
    return keyed.join(dropped, list(ROW_KEY), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
