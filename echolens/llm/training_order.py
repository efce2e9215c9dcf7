"""Token shards in training order: a keyed Feistel permutation, fixed-stride records, resumable reads.

A record is a header (``doc_id`` and flags, first id, number of ids) and a fixed number of ids, so its place in a
shard file follows from its slot, and a reader can start anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import stored
from echolens.llm.tokens import chunks, encoder

_ROUNDS = 6
# Each task numbers its sequences below this bound.
_LOCAL_BITS = 33
_HEADER = np.dtype([("doc", "<i8"), ("start", "<u4"), ("length", "<u4")])
# Tasks that write, shards that are summed together, and first slots that are sent to all tasks.
_WRITERS, _RUN, _SENT_SHARDS = 65_536, 1_024, 1_000_000
_NO_ID = 1 << 31  # flag in ``length``: the document's id is null


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A keyed round function on 64-bit words (multiply and fold)."""
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def permute(numbers: np.ndarray, domain: int, key: int) -> np.ndarray:
    """A keyed bijection of [0, domain): a balanced Feistel network on the next even power of two.

    Values that fall outside of the domain are sent through again until they fall inside (cycle-walking), which
    keeps the map one-to-one.
    """
    half = max(1, -(-max(1, (domain - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(key).integers(0, 1 << 63, _ROUNDS, np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return left << shift | right

    with np.errstate(over="ignore"):
        out = network(numbers.astype(np.uint64))
        while (outside := out >= domain).any():
            out[outside] = network(out[outside])
    return out


def _records(path: str, window: int, eod: int, tasks: int, width: int, key: int) -> Callable:
    """Encode documents, cut sequences and give each its permuted number and shard; records travel without padding."""

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, local = encoder(path), 0
        end = np.array([eod], encode.dtype)
        domain = tasks << _LOCAL_BITS
        for batch in batches:
            for first, last in chunks(batch, "_text", 2_000_000):
                part = batch.slice(first, last - first)
                found = encode.ids_of(part.column("_text").to_pylist())
                raw = np.concatenate([x for ids in found for x in (ids, end)]).tobytes()
                sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
                pieces = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                head = np.zeros(len(doc), _HEADER)
                ids = part.column("_id")
                head["doc"] = ids.fill_null(0).to_numpy(zero_copy_only=False)[doc]
                head["start"] = start
                length = np.minimum(sizes[doc] - start, window)
                head["length"] = length | np.where(ids.is_null().to_numpy(zero_copy_only=False)[doc], _NO_ID, 0)
                begin = (np.repeat(np.cumsum(sizes) - sizes, pieces) + start) * encode.dtype.itemsize
                heads, bounds = head.tobytes(), zip(begin.tolist(), (begin + length * encode.dtype.itemsize).tolist())
                at = _HEADER.itemsize
                blobs = [heads[k * at : k * at + at] + raw[x:y] for k, (x, y) in enumerate(bounds)]
                task = part.column("_task")[0].as_py()
                numbers = np.arange(local, local + len(blobs), dtype=np.uint64) | np.uint64(task << _LOCAL_BITS)
                local += len(blobs)
                order = permute(numbers, domain, key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((order // np.uint64(width)).astype(np.int32)), pa.array(order.astype(np.int64)),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["shard", "_order", "_record"],
                )

    return records


def shard_count(total: float) -> int:
    """Shards for so many bytes of records: of 16 MB while 4,096 of them are enough, then larger ones up to 256 MB."""
    return max(1, round(total / min(256e6, max(16e6, total / 4096))))


def write_training_order(
    docs: DataFrame,
    tokenizer_path: str,
    out: str,
    window: int = 512,
    eod: int = 0,
    key: int = 1,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the sequences of ``docs`` in a keyed random order to ``out``, one file per shard.

    A document (null text: empty) is its ids and ``eod``, cut into sequences of ``window`` ids, the last one padded
    with ``eod``. Every sequence has a number (its task and place there), which the permutation sends to a point of
    the same domain; the points in order are the slots. As points are spread evenly, equal ranges of them make
    shards of about one size (``shard_count`` of the expected bytes, unless given), and a record's shard is known before
    any other record is. So documents are encoded once, records move once, and no count of sequences is needed
    beforehand; slots come from the file sizes (``shard_starts``). A task writes a range of shards one after the other
    through Spark's text writer, so a lost task is repeated whole. ``out`` must be in storage that all executors reach.

    Ids are whole numbers or null. Rows that repeat are documents of their own; a null or empty text is one sequence.
    An empty table leaves an empty folder, which is read as no sequences. Other columns are not read.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    texts = keyed.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
    width = encoder(tokenizer_path).dtype.itemsize
    stride = _HEADER.itemsize + window * width
    # About two and a half bytes per id; only the size of the shards depends on it.
    sequences = (texts[0] or 0) / 2.5 / window + texts[1] / 2
    shards = shards or shard_count(sequences * stride)
    tasks = max(1, keyed.rdd.getNumPartitions())
    reach = -(-(tasks << _LOCAL_BITS) // shards)
    writers = min(shards, _WRITERS)
    padding = F.lit(bytes(np.array([eod], f"<u{width}").tobytes()))
    (
        keyed.withColumn("_task", F.spark_partition_id().cast("long"))
        .mapInArrow(_records(tokenizer_path, window, eod, tasks, reach, key), "shard int, _order long, _record binary")
        .repartitionById(writers, F.floor(F.col("shard").cast("long") * writers / shards).cast("int"))
        .sortWithinPartitions("shard", "_order")
        .select("shard", F.rpad("_record", F.lit(stride), padding).cast("string").alias("value"))
        .write.partitionBy("shard")
        .text(out)
    )


def _stride(window: int, width: int) -> int:
    return _HEADER.itemsize + window * width + 1  # the text writer ends each record with one byte


def shard_starts(files: DataFrame, stride: int) -> DataFrame:
    """First slot of each shard from the sizes of the files: ``shard, records, first_slot``.

    Sums over runs of shards first, then within each run, so no window holds all shards.
    """
    sized = files.select(
        F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int").alias("shard"), F.expr(f"length div {stride}").alias("records")
    ).withColumn("_run", F.floor(F.col("shard") / _RUN))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sized.groupBy("_run").agg(F.sum("records").alias("_records"))
    runs = runs.select("_run", F.coalesce(F.sum("_records").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inside", F.coalesce(F.sum("records").over(inside), F.lit(0)))
    return placed.join(runs, "_run").select("shard", "records", (F.col("_before") + F.col("_inside")).alias("first_slot"))


def _parse(window: int, width: int) -> Callable:
    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        record = np.dtype([("head", _HEADER), ("ids", f"<u{width}", (window,)), ("end", "u1")])
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("shard", "first_slot", "from_record", "content")])
            for shard, first, skip, content in rows:
                read = np.frombuffer(content, record)[skip:]
                for start in range(0, len(read), 1024):
                    part = read[start : start + 1024]
                    head = part["head"]
                    length = head["length"] & (_NO_ID - 1)
                    place = np.arange(skip + start, skip + start + len(part))
                    ids = [row[:n].astype("<u4").tobytes() for row, n in zip(part["ids"], length.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(first + place), pa.array(np.full(len(part), shard, np.int32)),
                            pa.array(place * record.itemsize),
                            pa.array(head["doc"].astype(np.int64), mask=head["length"] >= _NO_ID),
                            pa.array(head["start"].astype(np.int64)), pa.array(length.astype(np.int64)),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["slot", "shard", "byte_offset", "doc_id", "start", "length", "ids"],
                    )

    return parse


def read_training_order(spark, out: str, window: int = 512, width: int = 2, from_slot: int = 0) -> DataFrame:
    """The sequences from ``from_slot`` on: ``slot, shard, byte_offset, doc_id, start, length, ids``.

    Shards before that slot are not opened; of the shard that holds it, records before it are skipped by offset. The
    first slots, three numbers per shard, are sent to all tasks as long as there are at most a million of them (shards
    of 256 MB: 256 TB); contents are read where they are parsed. A folder without shards has no sequences.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(out)
    # Written without a shard, an empty table leaves a file of its own.
    files = files.where(F.col("path").rlike(r"/shard=\d+/"))
    stride = _stride(window, width)
    starts = shard_starts(files.select("path", "length"), stride).where(F.col("first_slot") + F.col("records") > from_slot)
    wanted = stored(
        starts.select("shard", "first_slot", F.greatest(F.lit(from_slot) - F.col("first_slot"), F.lit(0)).alias("from_record")),
        "shard-starts",
    )
    few = wanted.limit(_SENT_SHARDS + 1).count() <= _SENT_SHARDS
    return (
        files.select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int").alias("shard"), "content")
        .join(F.broadcast(wanted) if few else wanted, "shard")
        .select("shard", "first_slot", "from_record", "content")
        .mapInArrow(
            _parse(window, width),
            "slot long, shard int, byte_offset long, doc_id long, start long, length long, ids binary",
        )
    )
