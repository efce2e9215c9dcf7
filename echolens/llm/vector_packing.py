"""Vector best-fit packing: sequences as bins with a capacity of tokens, of documents and of attention cost.

A piece of n tokens takes n tokens, one document and n * (n + 1) / 2 of attention cost, since a token attends to its own
document only. Pieces are placed from long to short; of the bins with room in every dimension, the one that the rule
finds tightest takes the piece. Pieces of one length are alike, and a bin that has taken one is tighter than before, so
it takes the next one as well as long as there is room: a length is placed with a few array operations, whatever the
number of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import stored
from echolens.llm.tokens import chunks, encoder

# A task packs so many pieces, or pieces of so many tokens, at a time; more of them fill bins no better.
_SHARD_PIECES, _SHARD_TOKENS = 32_768, 8_000_000
# Bins filled to less than this share are opened again, and their pieces packed together with those of other tasks.
_WELL_FILLED = 0.995

_PLACED = "doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long, _filled long"


def needs(lengths: np.ndarray) -> np.ndarray:
    """Tokens, documents and attention cost of pieces."""
    n = np.asarray(lengths, np.int64)
    return np.stack((n, np.ones_like(n), n * (n + 1) // 2), axis=1)


def best_fit(
    lengths: np.ndarray, capacity: Sequence[int], weights: Sequence[float] = (1.0, 0.01, 0.01), rule: str = "norm"
) -> np.ndarray:
    """The bin of each piece. No bin exceeds a capacity; a piece that exceeds one by itself is an error.

    Residuals and needs are taken as shares of the capacities. ``norm`` chooses the bin with the least weighted squared
    norm of what is left when the piece is in it, ``dot`` the least weighted inner product of the bin's residual with the
    piece's needs, so the tightest in what the piece needs most. Ties go to the bin opened first. Under both rules, a
    bin that takes a piece ranks before all others for the next piece of that length.
    """
    limits, weights = np.asarray(capacity, np.int64), np.asarray(weights, np.float64)
    order = np.argsort(-lengths, kind="stable")
    values, counts = np.unique(lengths, return_counts=True)
    if len(values) and (needs(values[-1:]) > limits).any():
        raise ValueError("a piece is larger than a sequence")
    residual, bins = np.empty((max(16, len(lengths)), 3), np.int64), 0
    bin_of, placed = np.empty(len(lengths), np.int64), 0
    for length, count in zip(values[::-1].tolist(), counts[::-1].tolist()):
        need = needs([length])[0]
        left = residual[:bins]
        fits = np.flatnonzero((left >= need).all(1))
        if len(fits):
            if rule == "norm":
                score = ((((left[fits] - need) / limits) ** 2) * weights).sum(1)
            else:
                score = ((left[fits] / limits) * (need / limits) * weights).sum(1)
            fits = fits[np.argsort(score, kind="stable")]
            room = (left[fits] // need).min(1)
            before = np.cumsum(room) - room
            taken = np.clip(count - before, 0, room)
            fits, taken = fits[taken > 0], taken[taken > 0]
            residual[fits] -= taken[:, None] * need
        else:
            taken = np.empty(0, np.int64)
        rest = count - int(taken.sum())
        each = int((limits // need).min())
        new = -(-rest // each)
        more = np.full(new, each)
        if new:
            more[-1] = rest - each * (new - 1)
        residual[bins : bins + new] = limits - more[:, None] * need
        targets = np.repeat(np.concatenate((fits, np.arange(bins, bins + new))), np.concatenate((taken, more)))
        bin_of[order[placed : placed + count]] = targets
        placed, bins = placed + count, bins + new
    return bin_of


class _Shard:
    """Pieces waiting to be packed by one task."""

    def __init__(self, capacity: Sequence[int], weights: Sequence[float], rule: str, round_: int):
        from pyspark import TaskContext

        self.capacity, self.weights, self.rule = capacity, weights, rule
        # Sequence ids: the task, the sequence's number there, the round.
        self.task, self.round = TaskContext.get().partitionId(), round_
        self.made = 0
        self.clear()

    def clear(self) -> None:
        self.doc, self.piece, self.start, self.ids, self.tokens = [], [], [], [], 0

    def add(self, doc, piece: int, start: int, ids: bytes) -> None:
        self.doc.append(doc)
        self.piece.append(piece)
        self.start.append(start)
        self.ids.append(ids)
        self.tokens += len(ids) // 4

    def full(self) -> bool:
        return len(self.doc) >= _SHARD_PIECES or self.tokens >= _SHARD_TOKENS

    def packed(self, kind) -> Iterator:
        """All pieces with their places, and an empty shard."""
        import pyarrow as pa

        if not self.doc:
            return
        lengths = np.fromiter(map(len, self.ids), np.int64, len(self.ids)) // 4
        bin_of = best_fit(lengths, self.capacity, self.weights, self.rule)
        order = np.argsort(bin_of, kind="stable")
        bins, sizes = bin_of[order], lengths[order]
        ends = np.cumsum(sizes)
        firsts = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        base = np.repeat((ends - sizes)[firsts], np.diff(np.append(firsts, len(bins))))
        filled = np.bincount(bins, sizes).astype(np.int64)[bins]
        sequence = self.task << 33 | (self.made + bins) << 1 | self.round
        self.made += int(bins[-1]) + 1
        for s in range(0, len(order), 2048):
            at = order[s : s + 2048]
            cut = slice(s, s + 2048)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.doc[i] for i in at], kind), pa.array([self.piece[i] for i in at], pa.int32()),
                    pa.array([self.start[i] for i in at], pa.int64()), pa.array(sizes[cut]),
                    pa.array([self.ids[i] for i in at], pa.binary()), pa.array(sequence[cut]),
                    pa.array((ends - sizes - base)[cut]), pa.array(filled[cut]),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "_filled"],
            )
        self.clear()


def _cut_and_pack(path: str, window: int, eod: int, capacity: Sequence[int], weights: Sequence[float], rule: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        encode, kind = encoder(path), None
        shard = _Shard(capacity, weights, rule, 0)
        for batch in batches:
            kind = batch.schema.field("_id").type
            for first, last in chunks(batch, "_text", 2_000_000):
                part = batch.slice(first, last - first)
                for doc, found in zip(part.column("_id").to_pylist(), encode.ids_of(part.column("_text").to_pylist())):
                    ids = np.full(len(found) + 1, eod, "<u4")
                    ids[:-1] = found
                    raw = ids.tobytes()
                    for piece, at in enumerate(range(0, len(raw), 4 * window)):
                        shard.add(doc, piece, piece * window, raw[at : at + 4 * window])
                        if shard.full():
                            yield from shard.packed(kind)
        yield from shard.packed(kind)

    return run


def _pack_again(capacity: Sequence[int], weights: Sequence[float], rule: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        shard, kind = _Shard(capacity, weights, rule, 1), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids")]):
                shard.add(*row)
                if shard.full():
                    yield from shard.packed(kind)
        yield from shard.packed(kind)

    return run


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    eod: int = 0,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: Sequence[float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    A document is its ids (null text: none) and ``eod``; one of more than ``window`` ids is cut into pieces of ``window``
    ids, the last one may be shorter. A sequence holds at most ``window`` ids, ``max_documents`` pieces and
    ``max_attention`` of attention cost; the defaults, ``window`` pieces and the cost of one whole window, leave the
    tokens as the tightest constraint, so that there are as few sequences as can be. ``ids`` are little-endian unsigned
    32-bit numbers. Rows that repeat and null ids are documents of their own. An empty table gives no pieces. Other
    columns are not read, whatever their names.

    Tasks pack what they have read, without a shuffle, a shard at a time. Pieces of bins that stay below 99.5 % meet in a
    second round, dealt out by a hash, and are packed once more, whatever their number.
    """
    capacity = (
        window,
        window if max_documents is None else max_documents,
        window * (window + 1) // 2 if max_attention is None else max_attention,
    )
    schema = _PLACED.format(kind=dict(docs.dtypes)[id_col])
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    first = stored(texts.mapInArrow(_cut_and_pack(tokenizer_path, window, eod, capacity, weights, rule), schema), "fitted")
    well = F.col("_filled") >= _WELL_FILLED * window
    loose = first.where(~well)
    size = loose.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-size[0] // _SHARD_PIECES), -(-size[1] // _SHARD_TOKENS))
    # In one order, so that a task that is repeated packs as it did before.
    dealt = loose.repartition(tasks, F.xxhash64("sequence_id", "offset")).sortWithinPartitions("sequence_id", "offset")
    again = dealt.mapInArrow(_pack_again(capacity, weights, rule), schema)
    return first.where(well).unionByName(again).drop("_filled")
