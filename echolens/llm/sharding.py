"""Sharding by a k-d tree over metadata: recursive splits at distributed weighted medians."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import ROW_KEY, gapless, stored, with_row_key

# A coordinate has 31 bits; 32 bits of a hash below it order the rows that share it.
_COORDINATE = 1 << 31
_TIE_BITS = 32
# Each round of a median search looks at this many buckets per node.
_BUCKETS = 4096


def category(column: Column) -> Column:
    """Coordinate of a categorical column: rows of one value lie together, values in a fixed arbitrary order."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(column), 33), F.lit(0).cast("long"))


def magnitude(column: Column) -> Column:
    """Coordinate of a non-negative number on a logarithmic scale (null and negative: 0)."""
    value = F.log2(F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)
    return F.least(value * (1 << 25), F.lit(float(_COORDINATE - 1))).cast("long")


def _assign(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Set each row's node (``_lo``, ``_hi``: its shards) after a level of splits.

    The splits of a level are at most one row per shard, so they are broadcast.
    """
    placed = rows.join(F.broadcast(splits.select("_lo", "_mid", "_dim", "_cut")), "_lo", "left")
    left = _key(F.col("_dim")) <= F.col("_cut")
    return placed.select(
        *[c for c in rows.columns if c not in ("_lo", "_hi")],
        F.when(F.col("_mid").isNull() | left, F.col("_lo")).otherwise(F.col("_mid")).alias("_lo"),
        F.when(F.col("_mid").isNull() | ~left, F.col("_hi")).otherwise(F.col("_mid")).alias("_hi"),
    )


def _key(dim: Column) -> Column:
    """Place of a row along dimension number ``dim``: coordinate, then hash, so that no two rows stay together."""
    return F.shiftleft(F.get("_at", dim), _TIE_BITS).bitwiseOR(F.col("_tie"))


def _split(rows: DataFrame, starts: DataFrame, spans: Sequence[int], total: int, shards: int) -> DataFrame:
    """One split per open node: the widest dimension, the key up to which rows go left, and the bytes on the left.

    ``starts`` has the bytes before each node (``_before``). The weighted median (for odd shard counts: the
    proportionate quantile) is narrowed in rounds: each looks at
    4,096 buckets of the interval that holds it, summed in each task before the shuffle, and goes on with the span of
    the keys actually seen in the right bucket. It ends at a single key, the one at which the left side comes nearest.
    """
    dims = len(spans)
    widths = [
        (F.max(F.get("_at", F.lit(d))) - F.min(F.get("_at", F.lit(d)))).alias(f"_w{d}") for d in range(dims)
    ]
    width = [F.col(f"_w{d}") / float(max(1, span)) for d, span in enumerate(spans)]
    widest = F.greatest(*width) if dims > 1 else width[0]
    dim = F.lit(0)
    for d in reversed(range(dims)):
        dim = F.when(width[d] == widest, d).otherwise(dim)
    share = F.floor((F.col("_hi") - F.col("_lo")) / 2)
    # All cuts aim at the same marks, equal parts of the whole, so that errors of earlier cuts are made up and do not
    # add up; a node that has less than its part leaves no side without a share.
    aim = F.col("_mid").cast("long") * total / shards - F.col("_before")
    nodes = stored(
        rows.where("_hi - _lo > 1")
        .groupBy("_lo", "_hi")
        .agg(*widths)
        .join(F.broadcast(starts), "_lo")
        .withColumn("_mid", (F.col("_lo") + share).cast("int"))
        .select("_lo", "_hi", "_mid", dim.alias("_dim"), F.greatest(aim, F.lit(0.0)).alias("_need"), "_before"),
        "nodes",
    )
    keyed = rows.drop("_hi").join(F.broadcast(nodes), "_lo").withColumn("_k", _key(F.col("_dim")))
    here = ["_lo", "_hi", "_mid", "_dim", "_need", "_before"]
    state = stored(
        keyed.groupBy(*here)
        .agg(F.min("_k").alias("_from"), F.max("_k").alias("_to"))
        .withColumn("_below", F.lit(0).cast("long"))
        .withColumn("_at_key", F.lit(0).cast("long")),
        "medians",
    )
    while not state.where("_from < _to").isEmpty():
        step = F.floor((F.col("_to") - F.col("_from")) / _BUCKETS) + 1
        inside = keyed.select("_lo", "_k", "_weight").join(F.broadcast(state), "_lo")
        buckets = (
            inside.where("_k between _from and _to")
            .withColumn("_bucket", F.floor((F.col("_k") - F.col("_from")) / step))
            .groupBy(*here, "_below", "_bucket")
            .agg(F.sum("_weight").alias("_sum"), F.min("_k").alias("_from"), F.max("_k").alias("_to"))
        )
        # At most 4,096 buckets per node, folded in order up to the one in which the needed weight is reached.
        ordered = F.sort_array(F.collect_list(F.struct("_bucket", "_sum", "_from", "_to")))
        start = F.struct(
            F.col("_below").alias("below"), F.lit(0).cast("long").alias("sum"),
            F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to"),
        )

        def fold(a: Column, b: Column) -> Column:
            reached = (a["below"] + a["sum"] >= F.col("_need")) & (a["sum"] > 0)
            after = F.struct(
                (a["below"] + a["sum"]).alias("below"), b["_sum"].alias("sum"), b["_from"].alias("from"),
                b["_to"].alias("to"),
            )
            return F.when(reached, a).otherwise(after)

        found = buckets.groupBy(*here, "_below").agg(ordered.alias("_all")).withColumn(
            "_hit", F.aggregate("_all", start, fold)
        )
        state = stored(
            found.select(
                *here, F.col("_hit.from").alias("_from"), F.col("_hit.to").alias("_to"),
                F.col("_hit.below").alias("_below"), F.col("_hit.sum").alias("_at_key"),
            ),
            "medians",
        )
    # The row at the median goes to the side that then is nearer to its share.
    left = F.col("_below") + F.col("_at_key") / 2 <= F.col("_need")
    return state.select(
        *here, F.when(left, F.col("_from")).otherwise(F.col("_from") - 1).alias("_cut"),
        (F.col("_before") + F.col("_below") + F.when(left, F.col("_at_key")).otherwise(0)).alias("_middle"),
    )


def shard(
    docs: DataFrame,
    dims: Sequence[Column],
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot`` and the row key.

    ``dims`` are long coordinates in [0, 2**31) (see ``category`` and ``magnitude``). A node that must give n shards
    is split along the dimension in which it is widest relative to the whole table, where the bytes up to there are
    nearest to the like part of all bytes, floor(n/2) shards on the left, until each leaf is one shard. So a shard is at
    most one text away from the mean. Give the number of shards, or ``target_bytes`` for as many as the bytes need. ``size``
    is the UTF-8 bytes of the text (null: none) plus ``overhead``. Ties along a dimension are split by a hash of
    row and text, so a value, a length or a copied text that fills a third of the table does not stick to one shard;
    ``slot`` counts the rows of each shard from 0. An empty table gives no rows; fewer rows than shards leave
    shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    base = stored(
        with_row_key(docs).select(
            F.col(id_col).alias("_id"), (F.octet_length(text) + overhead).cast("long").alias("_weight"),
            crc.alias("_crc"), F.array(*dims).alias("_at"), *ROW_KEY,
            F.shiftrightunsigned(F.xxhash64(F.col(id_col), crc, *ROW_KEY), 32).alias("_tie"), F.lit(0).alias("_lo"),
        ),
        "shard-rows",
    )
    total = base.agg(F.sum("_weight")).first()[0] or 0
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    widths = [F.max(F.get("_at", F.lit(d))) - F.min(F.get("_at", F.lit(d))) for d in range(len(dims))]
    spans = [value or 0 for value in base.agg(*widths).first()]
    rows = base.withColumn("_hi", F.lit(shards))
    starts = docs.sparkSession.createDataFrame([(0, 0)], "_lo int, _before long")
    # Every level is stored with its rows' nodes, so that the passes of the next one need no earlier split.
    for level in range(math.ceil(math.log2(shards))):
        splits = stored(_split(rows, starts, spans, total, shards), "splits")
        rows = stored(_assign(rows, splits), f"shard-rows-{level + 1}")
        starts = stored(
            starts.unionByName(splits.select(F.col("_mid").alias("_lo"), F.col("_middle").cast("long").alias("_before"))), "starts"
        )
    placed = rows.select("_id", "_weight", "_crc", "_tie", *ROW_KEY, F.col("_lo").alias("shard"))
    return gapless(placed, ["shard"], ["_tie", "_id", *ROW_KEY], "slot", F.col("_tie")).select(
        F.col("_id").alias("doc_id"), F.col("_weight").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot",
        *ROW_KEY,
    )
