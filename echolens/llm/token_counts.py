"""Token counts with a digest cache: each distinct text is encoded once per tokenizer version, ever."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import ROW_KEY, stored, with_row_key
from echolens.llm.tokens import chunks, encoder, tokenizer_digest

# Rows to encode are told by bits, a map for each run of so many rows of a file (the size of Spark's bitmaps, 4 kB).
_RUN = 32_768
# Maps that take as many bytes as so many digests (32 bytes each) are sent to all tasks; more are joined by shuffle.
_BROADCAST_DIGESTS = 1 << 19


def _count_batches(path: str) -> Callable:
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path)
        for batch in batches:
            for start, end in chunks(batch, "_text"):
                part = batch.slice(start, end - start)
                counts = [len(ids) for ids in encode.ids_of(part.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
                )

    return count


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: F.coalesce(text, F.lit("")),
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, content`` (the digest of its normalised text).

    ``normalise`` must not change what the tokenizer sees; the default only makes null empty. ``cache_path`` is a
    Parquet table (content, n_tokens) by tokenizer version in storage that all executors reach; it is made at the first
    run. Digests are joined to the counts stored for this version, only distinct misses are encoded, and they are
    appended before the documents are joined to the cache again, so a lost executor costs no stored count. Of the cache
    only this version's counts are read, and only those of digests in ``docs`` are grouped.

    Texts are not shuffled: the rows to encode are told to the tasks that read them by a bit per row. Only a table of
    more than about 130 million rows, or very many small files, joins its texts to these bits by shuffle. No begin, end or padding tokens count; special strings in a text count as
    the library has it. Null ids and rows that repeat are rows of their own. An empty table gives no rows and stores
    nothing. Other columns are not read. The tokenizer file must be at the same path on all executors.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = normalise(F.col(f"`{text_col}`"))
    content = F.unhex(F.sha2(text, 256)).alias("content")

    def known(wanted: DataFrame) -> DataFrame | None:
        try:
            cache = spark.read.schema("content binary, n_tokens long, tokenizer string").parquet(cache_path)
        except AnalysisException:
            return None
        counts = cache.where(F.col("tokenizer") == version).join(wanted, "content", "left_semi")
        # Two runs that filled the cache at the same time may both have stored a text.
        return counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    keys = [c for c in ROW_KEY if c in docs.columns]
    columns = dict.fromkeys([id_col, text_col, *keys])
    named = with_row_key(docs.select(*[F.col(f"`{c}`") for c in columns]))
    file, row = ROW_KEY
    run, place = F.floor(F.col(row) / _RUN).alias("_run"), F.pmod(F.col(row), F.lit(_RUN))
    wanted = docs.select(content).distinct()
    # One row of each distinct text that has no count is encoded where it is read; only digests and names of rows travel.
    firsts = named.select(content, *ROW_KEY).groupBy("content").agg(F.min(F.struct(*ROW_KEY)).alias("_first"))
    if (cached := known(wanted)) is not None:
        firsts = firsts.join(cached.select("content"), "content", "left_anti")
    maps = firsts.select("_first.*").select(file, run, place.alias("_place")).repartition(file, "_run").groupBy(file, "_run")
    maps = stored(maps.agg(F.bitmap_construct_agg("_place").alias("_map")), "missing")
    sent = _BROADCAST_DIGESTS * 32 * 8 // _RUN
    few = maps.limit(sent + 1).count() <= sent
    byte = F.conv(F.hex(F.substring("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    chosen = F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
    texts = named.withColumn("_run", run).join(F.broadcast(maps) if few else maps, [file, "_run"])
    misses = texts.where(chosen).select(content, text.alias("_text"))
    counted = misses.mapInArrow(_count_batches(tokenizer_path), "content binary, n_tokens long")
    stamped = counted.select("content", "n_tokens", F.lit(version).alias("tokenizer"))
    stamped.write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_bytes"), content, *keys,
    )
    # Stored, so that the join deals both sides out itself and Spark may split a text that many rows share.
    return rows.join(stored(known(wanted), "counts"), "content").select("doc_id", "n_bytes", "n_tokens", "content", *keys)
