"""Lexical retrieval packing: windows are filled with the BM25 neighbours of a seed document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import stored
from echolens.llm.tokens import chunks, encoder

_K1, _B = 1.2, 0.75
# Terms of a seed that are looked up at a time (rarest first, of those that unused documents have) and neighbours ranked.
_QUERY_TERMS = 24
_NEIGHBOURS = 16
# Low ids are the first merges, common in any text; they come last when a document is routed to a shard.
_COMMON_IDS = 2_000

_PIECE = "doc_id {kind}, start long, length long, doc_tokens long, ids binary"


def _cut(path: str, window: int, eod: int) -> Callable:
    """Whole windows of each document, and its rest with the route that brings like rests to one shard."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(path)
        vocabulary = len(encode.leads)
        rank = np.random.default_rng(0).permutation(max(vocabulary, eod + 1)).astype(np.int64) + _COMMON_IDS
        rank[:_COMMON_IDS] += vocabulary
        for batch in batches:
            for first, last in chunks(batch, "_text", 2_000_000):
                part = batch.slice(first, last - first)
                source, start, total, blobs, routes = [], [], [], [], []
                for i, found in enumerate(encode.ids_of(part.column("_text").to_pylist())):
                    ids = np.full(len(found) + 1, eod, "<u4")
                    ids[:-1] = found
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        source.append(i)
                        start.append(at)
                        total.append(len(ids))
                        blobs.append(piece.tobytes())
                        if len(piece) == window:
                            routes.append(None)
                        else:
                            ranks = rank[piece]
                            least = ranks.min()
                            others = ranks[ranks != least]
                            routes.append(int(least) << 24 | int(others.min() if len(others) else least))
                sizes = [len(b) // 4 for b in blobs]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id").take(pa.array(source, pa.int64())), pa.array(start, pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array(total, pa.int64()), pa.array(blobs, pa.binary()),
                        pa.array(routes, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "_route"],
                )

    return cut


class _Index:
    """BM25 inverted index over the rests of one shard: postings of each term with their weights."""

    def __init__(self, rests: list[np.ndarray]):
        self.size = len(rests)
        lengths = np.array([len(r) for r in rests])
        owner = np.repeat(np.arange(self.size), lengths).astype(np.int64)
        pairs, counts = np.unique(np.concatenate(rests).astype(np.int64) << 32 | owner, return_counts=True)
        terms, self.owners = pairs >> 32, pairs & 0xFFFFFFFF
        self.terms, firsts, self.frequency = np.unique(terms, return_index=True, return_counts=True)
        self.bounds = np.append(firsts, len(pairs))
        idf = np.log1p((self.size - self.frequency + 0.5) / (self.frequency + 0.5))
        norm = _K1 * (1 - _B + _B * lengths / lengths.mean())
        weights = counts * (_K1 + 1) / (counts + norm[self.owners])
        self.weights = weights * np.repeat(idf, self.frequency)

    def question(self, rest: np.ndarray) -> np.ndarray:
        """Places of the terms of ``rest`` that other documents have, rarest first."""
        at = np.searchsorted(self.terms, np.unique(rest))
        at = at[self.frequency[at] > 1]
        return at[np.argsort(self.frequency[at], kind="stable")]

    def neighbours(self, question: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term of the question, best first; none only if no unused document does.

        Slices of terms, rarest first, are looked up until one leads to unused documents.
        """
        for first in range(0, len(question), _QUERY_TERMS):
            spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in question[first : first + _QUERY_TERMS]]
            owners = np.concatenate([self.owners[s] for s in spans])
            weights = np.concatenate([self.weights[s] for s in spans])
            scores = np.bincount(owners, weights, self.size)
            scores[used] = 0
            found = np.flatnonzero(scores)
            if len(found):
                return found[np.argsort(-scores[found], kind="stable")[:_NEIGHBOURS]]
        return question[:0]


def fill_windows(rests: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first id, ids) over the rests of one shard.

    The next unused rest is a seed. Its unused neighbours follow in order of score; the first that does not fit whole
    is cut to fill the window, and what is left of it is used again later. When the neighbours ranked are placed, the
    index is asked again. Where no unused rest shares a term with the seed, the next rests in order follow, so only the
    last window of a shard has room.
    """
    index = _Index(rests)
    done = np.zeros(len(rests), np.int64)  # ids already placed
    used = np.zeros(len(rests), bool)
    following = 0
    while True:
        while following < len(rests) and used[following]:
            following += 1
        if following == len(rests):
            return
        seed, room, line, queue, alone = following, window, [], iter(()), False
        choice, question = seed, None
        while True:
            take = min(room, len(rests[choice]) - int(done[choice]))
            line.append((choice, int(done[choice]), take))
            done[choice] += take
            room -= take
            used[choice] = done[choice] == len(rests[choice])
            if not room:
                break
            choice = next((n for n in queue if not used[n]), None)
            if choice is None and not alone:
                question = index.question(rests[seed]) if question is None else question
                queue = iter(index.neighbours(question, used).tolist())
                choice = next(queue, None)
                alone = choice is None
            if choice is None:
                while following < len(rests) and used[following]:
                    following += 1
                if following == len(rests):
                    break
                choice = following
        yield line


def _pack(window: int, shard_rows: int) -> Callable:
    """Each run of ``shard_rows`` rows of a partition is one shard of the index."""

    def packed(rows, task: int, made: int) -> Iterator:
        import pyarrow as pa

        starts = rows.column("start").to_pylist()
        rests = [np.frombuffer(b, "<u4") for b in rows.column("ids").to_pylist()]
        source, start, length, blobs, sequence, offset = [], [], [], [], [], []
        for k, line in enumerate(fill_windows(rests, window)):
            at = 0
            for doc, first, size in line:
                source.append(doc)
                start.append(starts[doc] + first)
                length.append(size)
                blobs.append(rests[doc][first : first + size].tobytes())
                sequence.append(task << 33 | (made + k) << 1 | 1)
                offset.append(at)
                at += size
        for begin in range(0, len(source), 4096):
            part = slice(begin, begin + 4096)
            take = pa.array(source[part], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(take).combine_chunks(),
                    pa.array(start[part], pa.int64()), pa.array(length[part], pa.int64()),
                    rows.column("doc_tokens").take(take).combine_chunks(), pa.array(blobs[part], pa.binary()),
                    pa.array(sequence[part], pa.int64()), pa.array(offset[part], pa.int64()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"],
            )

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, made, waiting, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_rows - n)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                n += part.num_rows
                if n == shard_rows:
                    yield from packed(pa.Table.from_batches(waiting), task, made)
                    made, waiting, n = made + n, [], 0  # a shard has no more windows than rests
        if waiting:
            yield from packed(pa.Table.from_batches(waiting), task, made)

    return pack


def _dealt(rests: DataFrame, task_rows: int) -> DataFrame:
    """Rests in partitions of about ``task_rows`` by their first routing id, so that like rests meet.

    The rests are counted per first id, at most as many as the vocabulary has. Ids in order share partitions, and an id
    that more rests have than fit into one gets several, dealt by a hash of the row, since copies share all their ids.
    """
    first = F.shiftright("_route", 24)
    counts = sorted(tuple(r) for r in rests.groupBy(first.alias("id")).count().collect())
    plan, part, room = [], 0, task_rows
    for route, n in counts:
        if n > room and room < task_rows:
            part, room = part + 1, task_rows
        parts = -(-n // task_rows)
        plan.append((route, part, parts))
        part, room = (part, room - n) if parts == 1 and n < room else (part + parts, task_rows)
    kinds = "_first long, _from int, _parts int"
    deal = F.broadcast(rests.sparkSession.createDataFrame(plan, kinds))
    placed = rests.withColumn("_first", first).join(deal, "_first").withColumn("_place", F.xxhash64("doc_id", "start", "ids"))
    at = F.col("_from") + F.pmod("_place", "_parts")
    return placed.repartitionById(part + 1, at.cast("int")).sortWithinPartitions("_route", "_place", "start")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 1024,
    eod: int = 0,
    shard_rows: int = 4096,
    task_rows: int = 16_384,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    A document's ids (null text: none) and ``eod`` are cut into whole windows, each a sequence of its own, and a rest.
    Rests are dealt to tasks of about ``task_rows`` by the two rarest-ranked ids they hold, so that like rests meet; what
    many share is cut by a hash. A task takes shards of ``shard_rows`` one after the other, each with a BM25 index of its
    rests.
    ``ids`` are little-endian unsigned 32-bit numbers. Rows that repeat are documents of their own. An empty table
    gives no pieces. Encoded pieces are stored once, so a lost executor repeats no encoding.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = _PIECE.format(kind=kind) + ", _route long"
    pieces = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _cut(tokenizer_path, window, eod), schema
    )
    pieces = stored(pieces, "token-pieces")
    whole = pieces.where(F.col("_route").isNull()).select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        F.shiftleft(F.monotonically_increasing_id(), 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    rests = pieces.where(F.col("_route").isNotNull())
    packed = _dealt(rests, max(task_rows, shard_rows)).mapInArrow(
        _pack(window, shard_rows), _PIECE.format(kind=kind) + ", sequence_id long, offset long"
    )
    return packed.unionByName(whole)
