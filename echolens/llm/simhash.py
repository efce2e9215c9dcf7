"""SimHash near-duplicates by anchor points: fingerprints meet at the code words of a covering code.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit of their upper or of their
lower half. The anchors of a half are the words of the perfect Hamming code of 31 bits, taken with either value of the
32nd bit: every half lies within covering radius 1 of an anchor. Each half is replicated to all anchors within
covering radius plus threshold, 1 + 1. For two halves that differ in at most one bit, the anchor next to the first is
within 2 of the second, so they meet there. A fingerprint has at most 17 anchors per half, and an anchor few others:
there are 2**27 of them per half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import ROW_KEY, stored, with_row_key
from echolens.llm.components import connected_components
from echolens.llm.tokens import chunks

_SEED = 42
_THRESHOLD = 3
# Hashes whose bits are counted at a time.
_HASHES = 1 << 16
# An anchor with more fingerprints is cut into blocks of about so many; each pair of blocks is compared by itself.
_ANCHOR_PRINTS = 20_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text; a bit is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - width)
    spans = zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    hashes = [xxh64_intdigest(joined[a:b], _SEED) for a, b in spans]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _HASHES):
        part = np.array(hashes[start : start + _HASHES], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for start, end in chunks(batch, "_text"):
            part = batch.slice(start, end - start)
            # Only A-Z are lower-cased and only ASCII white space separates, which is what bytes do.
            prints = [fingerprint(text.encode()) if text else 0 for text in part.column("_text").to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *[part.column(c) for c in ROW_KEY], signed], names=["_id", *ROW_KEY, "_print"]
            )


def _covering() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of bytes, and per syndrome the patterns that lead from a half to the anchors within distance 2."""
    # Bit i of a half is position i + 1 of the code; the syndrome is the exclusive or of the positions set.
    syndromes = np.zeros((4, 256), np.uint8)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                position = 8 * byte + bit + 1
                if value >> bit & 1 and position <= 31:
                    syndromes[byte, value] ^= position
    top = 1 << 31
    patterns = np.zeros((32, 17), np.uint32)
    for s in range(32):
        nearest = 1 << (s - 1) if s else 0
        found = [nearest, nearest | top]
        if s:  # two positions that together give the syndrome
            found += [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s]
        patterns[s] = found + [nearest] * (17 - len(found))
    return syndromes, patterns


def anchors(half: np.ndarray) -> np.ndarray:
    """The anchors within distance 2 of each half, 17 columns; a half that is an anchor repeats itself."""
    syndromes, patterns = _covering()
    s = np.zeros(len(half), np.uint8)
    for byte in range(4):
        s ^= syndromes[byte][(half >> np.uint32(8 * byte)) & np.uint32(255)]
    return half[:, None] ^ patterns[s]


def _replicate(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        prints = batch.column("_print").to_numpy(zero_copy_only=False)
        for start in range(0, len(prints), 1 << 14):
            part = prints[start : start + (1 << 14)]
            bits = part.view(np.uint64)
            for side, half in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
                near = anchors(half.astype(np.uint32))
                keep = np.ones(near.shape, bool)
                keep[:, 2:] = near[:, 2:] != near[:, :1]
                keys = near.astype(np.int64) | np.int64(side << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[keep]), pa.array(np.repeat(part, keep.sum(1)))], names=["_anchor", "_print"]
                )


def _dealt(replicas: DataFrame) -> DataFrame:
    """``_key, _print``: fingerprints by anchor, those of a large anchor by anchor and pair of blocks.

    Each fingerprint of a large anchor goes to every pair its block is part of, so all of them still meet.
    """
    large = stored(
        replicas.groupBy("_anchor").count().where(F.col("count") > _ANCHOR_PRINTS)
        .select("_anchor", F.ceil(F.col("count") / _ANCHOR_PRINTS).cast("int").alias("_blocks")),
        "large-anchors",
    )
    if large.isEmpty():
        return replicas.withColumnRenamed("_anchor", "_key")
    own = F.pmod(F.xxhash64("_print"), F.col("_blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.xxhash64("_anchor", F.least(own, other.cast("long")), F.greatest(own, other.cast("long"))),
    )
    alone = F.array(F.col("_anchor"))
    return replicas.join(large, "_anchor", "left").select(
        F.explode(F.when(F.col("_blocks").isNull(), alone).otherwise(pairs)).alias("_key"), "_print"
    )


def _spanning(members: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Trees of the links among fingerprints that share an anchor: (fingerprints, root), each tree found once.

    Everything reached from a fingerprint is taken off the list at once, so a dense group costs a few passes, and
    never more links than members are given out.
    """
    open_ = np.unique(members)
    while len(open_) > 1:
        root, frontier, tree = open_[0], [open_[0]], []
        open_ = open_[1:]
        while frontier and len(open_):
            near = np.bitwise_count(open_ ^ frontier.pop()) <= _THRESHOLD
            if near.any():
                reached = open_[near]
                tree.append(reached)
                frontier.extend(reached)
                open_ = open_[~near]
        if tree:
            yield np.concatenate(tree), root


def _compare(batches: Iterator) -> Iterator:
    """Links within each key; batches come sorted by key, and a key may go on in the next batch.

    Keys that meet by chance only bring more fingerprints together; links are told by their bits.
    """
    import pyarrow as pa

    rest_keys, rest_prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(keys)]))
        left, right = [], []
        for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            for reached, root in _spanning(prints[start:end].view(np.uint64)):
                left.append(reached)
                right.append(np.full(len(reached), root))
        join = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(join[0]), pa.array(join[1])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((rest_keys, batch.column("_key").to_numpy(zero_copy_only=False)))
        prints = np.concatenate((rest_prints, batch.column("_print").to_numpy(zero_copy_only=False)))
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        rest_keys, rest_prints = keys[cut:], prints[cut:]
        if cut:
            yield links(keys[:cut], prints[:cut])
    if len(rest_keys) > 1:
        yield links(rest_keys, rest_prints)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, kept`` and the row key.

    Texts are lower-cased in A-Z, cut into words at ASCII white space and into shingles of three words (of all words
    if there are fewer). Texts without words, null among them, have fingerprint zero and are linked like any other.
    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest id reachable (null only if
    all are), and exactly one row of each component is kept, the one with that id, of several the one with the least
    row key. Copies are reduced to distinct fingerprints first; those meet at their anchors, the fingerprints of an
    anchor with more than 20,000 are compared by pairs of blocks, and only spanning links leave the task. An empty table
    gives no rows; rows that repeat are members of one component; other columns are not read.
    """
    keyed = with_row_key(docs)
    kind = dict(docs.dtypes)[id_col]
    key_types = ", ".join(f"{c} long" for c in ROW_KEY)
    prints = stored(
        keyed.select(F.col(id_col).alias("_id"), *ROW_KEY, F.col(text_col).alias("_text")).mapInArrow(
            _fingerprints, f"_id {kind}, {key_types}, _print long"
        ),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", *ROW_KEY))
    distinct = stored(prints.groupBy("_print").agg(first.alias("_first")), "distinct-fingerprints")
    links = stored(
        _dealt(distinct.select("_print").mapInArrow(_replicate, "_anchor long, _print long"))
        .repartition("_key")
        .sortWithinPartitions("_key")
        .mapInArrow(_compare, "a long, b long")
        .distinct(),
        "links",
    )
    roots = connected_components(links)
    member = distinct.join(roots, distinct["_print"] == roots["node"], "left").select(
        "_print", F.coalesce("component", "_print").alias("_root"), "_first"
    )
    heads = member.groupBy("_root").agg(F.min("_first").alias("_head"))
    # Stored, so that the join deals both sides out itself and Spark may split a fingerprint that many rows share.
    labelled = stored(member.join(heads, "_root").select("_print", "_head"), "labelled")
    own = F.lit(True)
    for name in ROW_KEY:
        own = own & (F.col(f"_head.{name}") == F.col(name))
    return prints.join(labelled, "_print").select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"),
        F.col("_head._id").alias("component_id"), own.alias("kept"), *ROW_KEY,
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, all columns and texts as they are; cases are those of ``near_copies``."""
    keyed = with_row_key(docs)
    dropped = near_copies(keyed, id_col, text_col).where(~F.col("kept")).select(*ROW_KEY)
    return keyed.join(dropped, list(ROW_KEY), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
