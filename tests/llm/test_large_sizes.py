"""Sums of sizes beyond 32 bits."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from echolens.llm import sharding


def test_marks_of_shards_beyond_32_bits(spark):
    """The bytes of all rows fit an int, those up to a cut times the shards do not."""
    docs = spark.range(150).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = sharding.shard(docs, [sharding.magnitude(F.col("doc_id"))], shards=7, overhead=10_000_000).collect()
    assert sum(r["size"] for r in rows) < 2**31 and sorted(r.doc_id for r in rows) == list(range(150))
    assert sorted(Counter(r.shard for r in rows).values()) == [21] * 4 + [22] * 3
