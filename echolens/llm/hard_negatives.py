"""Hard negatives by segment summaries: bounds from means and deviations decide which pairs are scored exactly.

A vector is cut into segments. For two segments of n components with means m, m' and deviations s, s', the inner product
lies within n * (m * m' - s * s') and n * (m * m' + s * s'), by Cauchy-Schwarz on what is left when the means are taken
off. The sums over all segments bound the score of a pair, and finer segments bound it more closely. Anchors meet rows in
cells, a group of anchors by a group of rows; there a pair passes from coarse to fine bounds, and only what all of them
leave open is scored exactly, against scores that the cell has found already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import stored

#: Segments of a vector, coarse to fine.
LEVELS = (4, 16, 32)
# A cell joins about so many anchors with so many rows; both bound memory and the rows that leave a cell.
_CELL_ANCHORS, _CELL_ROWS = 4_096, 65_536
# Tasks of one stage; each works through its cells one after another.
_TASKS = 4_096
# Pairs are bounded in blocks of so many anchors and rows.
_ANCHORS, _ROWS = 512, 1_024
# Above this share of open pairs a level is worked out for the whole block.
_DENSE = 0.2
# Rounding of the bounds, as a share of the product of both lengths.
_SLACK = 1e-5
# Integers up to here are exact in the type the products are taken in.
_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_ANCHOR, _POSITIVE, _ROW = 0, 1, 2

_RECORD = "row long, id long, label long, anchor boolean, vector binary, summary binary"


@dataclass(frozen=True)
class _Shape:
    """What all records of a table share: components, segment bounds by level, types of components and summaries."""

    width: int
    levels: tuple[int, ...]
    vector: str
    summary: str
    exact: bool  # every score is exact in double precision

    def cuts(self, segments: int) -> np.ndarray:
        return np.arange(segments + 1) * self.width // segments


def _summary(x: np.ndarray, shape: _Shape) -> np.ndarray:
    """Means and deviations of all segments of all levels, times the root of the segment's length, and the norm.

    With that factor the products of a bound are plain inner products.
    """
    out = []
    for segments in shape.levels:
        cuts = shape.cuts(segments)
        lengths = np.diff(cuts)
        means = np.add.reduceat(x, cuts[:-1], axis=1) / lengths
        apart = x - np.repeat(means, lengths, axis=1)
        deviations = np.sqrt(np.add.reduceat(apart * apart, cuts[:-1], axis=1) / lengths)
        out += [means * np.sqrt(lengths), deviations * np.sqrt(lengths)]
    out.append(np.sqrt((x * x).sum(1, keepdims=True)))
    return np.concatenate(out, axis=1).astype(shape.summary)


def _summarise(shape: _Shape, scale: int) -> Callable:
    """Whole-number components and their summaries as fixed-width bytes."""

    def summarise(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column("vector")
            ends = vectors.offsets.to_numpy()
            values = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
            sizes = np.diff(ends)
            x = np.zeros((len(sizes), shape.width))
            place = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)
            x[np.repeat(np.arange(len(sizes)), sizes), place] = np.floor(scale * values)
            packed = [
                pa.array([row.tobytes() for row in part], pa.binary()) for part in (x.astype(shape.vector), _summary(x, shape))
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "id", "label", "anchor")], *packed],
                names=["row", "id", "label", "anchor", "vector", "summary"],
            )

    return summarise


class _Side:
    """Vectors and summaries of anchors or of rows as matrices."""

    def __init__(self, shape: _Shape, row: np.ndarray, label: np.ndarray, vector: np.ndarray, summary: np.ndarray):
        self.shape, self.row, self.label, self.vector, self.summary = shape, row, label, vector, summary

    @classmethod
    def read(cls, shape: _Shape, batch) -> _Side:
        def matrix(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)

        return cls(
            shape, _longs(batch, "row"), _longs(batch, "label"), matrix("vector", shape.vector), matrix("summary", shape.summary)
        )

    @classmethod
    def joined(cls, sides: list[_Side]) -> _Side:
        return cls(
            sides[0].shape, *[np.concatenate([getattr(s, a) for s in sides]) for a in ("row", "label", "vector", "summary")]
        )

    def part(self, start: int, size: int) -> _Side:
        cut = slice(start, start + size)
        return _Side(self.shape, self.row[cut], self.label[cut], self.vector[cut], self.summary[cut])

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations of a level."""
        before = 2 * sum(self.shape.levels[:k])
        n = self.shape.levels[k]
        return self.summary[:, before : before + n], self.summary[:, before + n : before + 2 * n]

    @property
    def norm(self) -> np.ndarray:
        return self.summary[:, -1].astype(np.float64)


def _longs(batch, name: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(name).cast("int64"), _MOST).to_numpy(zero_copy_only=False)


def _scores(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs; beyond 64 bits they stay at the bound."""
    if a.shape.exact:
        out = np.empty(len(i), np.int64)
        if len(i) > _DENSE * len(a.row) * len(b.row):
            return (a.vector.astype(np.float64) @ b.vector.astype(np.float64).T)[i, j].astype(np.int64)
        for s in range(0, len(i), 1 << 16):
            left, right = a.vector[i[s : s + (1 << 16)]], b.vector[j[s : s + (1 << 16)]]
            out[s : s + (1 << 16)] = np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64))
        return out
    left, right = ([[int(x) for x in v] for v in side.vector.tolist()] for side in (a, b))
    products = (sum(map(int.__mul__, left[x], right[y])) for x, y in zip(i.tolist(), j.tolist()))
    return np.array([min(_MOST, max(_LEAST + 1, p)) for p in products], np.int64)


def _open_pairs(a: _Side, b: _Side, allowed: np.ndarray, floor: np.ndarray, ceiling: np.ndarray):
    """Pairs (anchor, row, score) with a score between the anchor's floor and ceiling, of those allowed."""
    slack = _SLACK * a.norm
    i = j = None
    for k in range(len(a.shape.levels)):
        (means, deviations), (other_means, other_deviations) = a.level(k), b.level(k)
        if i is None or len(i) > _DENSE * allowed.size:
            middle, span = means @ other_means.T, deviations @ other_deviations.T
            span = span + slack[:, None] * b.norm
            near = (middle + span >= floor[:, None]) & (middle - span <= ceiling[:, None])
            allowed = allowed & near
            i, j = np.nonzero(allowed)
        else:
            middle = np.einsum("ij,ij->i", means[i], other_means[j])
            span = np.einsum("ij,ij->i", deviations[i], other_deviations[j]) + slack[i] * b.norm[j]
            near = (middle + span >= floor[i]) & (middle - span <= ceiling[i])
            i, j = i[near], j[near]
        if not len(i):
            break
    if i is None:
        i, j = np.nonzero(allowed)
    return i, j, _scores(a, b, i, j)


class _Best:
    """The first ``k`` entries of each key: higher scores first, then smaller ids, then smaller rows."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.score = np.full((keys, k), _LEAST)
        self.id, self.row = np.full((keys, k), _MOST), np.full((keys, k), _MOST)

    def offer(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(key):
            return
        known = np.unique(key)
        keys = np.concatenate((np.repeat(known, self.k), key))
        parts = [np.concatenate((old[known].ravel(), new)) for old, new in ((self.score, score), (self.id, id_), (self.row, row))]
        order = np.lexsort((parts[2], parts[1], ~parts[0], keys))
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        first = rank < self.k
        for old, new in zip((self.score, self.id, self.row), parts):
            old[keys[first], rank[first]] = new[order][first]

    def last(self) -> np.ndarray:
        """The score that a new entry must reach; the least number while there is room."""
        return self.score[:, -1]

    def entries(self) -> tuple[np.ndarray, ...]:
        key, place = np.nonzero(self.score > _LEAST)
        return key, self.score[key, place], self.id[key, place], self.row[key, place]


class _Positives:
    """The best other rows with the anchor's label."""

    def __init__(self, anchors: _Side, wanted: int):
        self.anchors, self.best = anchors, _Best(len(anchors.row), wanted)

    def meet(self, rows: _Side, ids: np.ndarray) -> None:
        for start in range(0, len(self.anchors.row), _ANCHORS):
            part = self.anchors.part(start, _ANCHORS)
            allowed = (part.label[:, None] == rows.label) & (part.row[:, None] != rows.row)
            floor = self.best.last()[start : start + _ANCHORS].astype(np.float64)
            i, j, score = _open_pairs(part, rows, allowed, floor, np.full(len(floor), np.inf))
            self.best.offer(start + i, score, ids[j], rows.row[j])

    def result(self) -> list[np.ndarray]:
        key, *rest = self.best.entries()
        return [self.anchors.row[key], *rest]


class _Negatives:
    """The best rows of other labels within a band below each positive's score."""

    def __init__(self, anchors: _Side, positives: list[np.ndarray], places: int, wanted: int, low: int, high: int):
        row, place, score = positives
        self.anchors, self.places = anchors, places
        order = np.argsort(anchors.row)
        key = order[np.searchsorted(anchors.row, row, sorter=order)]
        self.low = np.full((len(anchors.row), places), _MOST)
        self.high = np.full((len(anchors.row), places), _LEAST)
        exact = score.astype(object)
        self.low[key, place] = -(-low * exact // 100)
        self.high[key, place] = high * exact // 100
        self.best = _Best(len(anchors.row) * places, wanted)

    def meet(self, rows: _Side, ids: np.ndarray) -> None:
        for start in range(0, len(self.anchors.row), _ANCHORS):
            part, cut = self.anchors.part(start, _ANCHORS), slice(start, start + _ANCHORS)
            low, high = np.maximum(self.low, self.best.last().reshape(self.low.shape))[cut], self.high[cut]
            open_ = low <= high
            floor = np.where(open_, low, _MOST).min(1).astype(np.float64)
            ceiling = np.where(open_, high, _LEAST).max(1).astype(np.float64)
            allowed = (part.label[:, None] != rows.label) & open_.any(1)[:, None]
            i, j, score = _open_pairs(part, rows, allowed, floor, ceiling)
            for place in range(self.places):
                near = (score >= low[i, place]) & (score <= high[i, place])
                at = i[near], j[near]
                self.best.offer((start + at[0]) * self.places + place, score[near], ids[at[1]], rows.row[at[1]])

    def result(self) -> list[np.ndarray]:
        key, *rest = self.best.entries()
        return [self.anchors.row[key // self.places], key % self.places, *rest]


def _cells(shape: _Shape, names: Sequence[str], make: Callable) -> Callable:
    """Work through cells: records come sorted by cell and kind, so anchors are there before the rows they meet."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cell, anchors, positives, work = None, [], [], None

        def start():
            side = _Side.joined(anchors)
            return make(side, [np.concatenate(x) for x in zip(*positives)] if positives else None)

        def finish() -> Iterator:
            if work is not None:
                found = work.result()
                for s in range(0, len(found[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 10_000], pa.int64()) for x in found], names=names)

        for batch in batches:
            at, kinds = _longs(batch, "cell"), _longs(batch, "kind")
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if first == last:
                    continue
                part, kind = batch.slice(first, last - first), kinds[first]
                if at[first] != cell:
                    yield from finish()
                    cell, anchors, positives, work = at[first], [], [], None
                if kind == _ANCHOR:
                    anchors.append(_Side.read(shape, part))
                elif kind == _POSITIVE:
                    positives.append([_longs(part, c) for c in ("row", "label", "id")])
                elif anchors:
                    work = work or start()
                    for s in range(0, part.num_rows, _ROWS):
                        rows = part.slice(s, _ROWS)
                        work.meet(_Side.read(shape, rows), _longs(rows, "id"))
        yield from finish()

    return run


def _first(found: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` of each key; a key has at most ``n`` rows from each of its cells."""
    order = [F.col("score").desc(), F.col("id"), F.col("found")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(
        F.col("place") < n
    )


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    levels: Sequence[int] = LEVELS,
) -> DataFrame:
    """Per anchor, positive and negative ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors. A component x counts as ``floor(scale * x)``, a score is the whole-number
    inner product (64 bits; larger ones count as the bound), a shorter vector is filled up with zeros. An anchor's
    positives are its first ``positives`` other rows of its label, and for each of them the first ``negatives`` rows of
    other labels follow whose score is ``low`` to ``high`` percent of the positive's, ends included; fewer where there
    are not so many. Higher scores come first, ties by smaller id, null ids last, then by the order of the rows.

    Ids are whole numbers; the largest long stands for null. Rows with a null label, a null vector or a component that
    is null or not finite take no part. Rows that repeat count each by itself, and a copy of an anchor may be its
    positive. An empty table, or one without anchors, gives no rows. Other columns are not read, whatever their names.

    All rows are compared with all anchors, a stated share of them, in cells of about 4,096 anchors and 65,536 rows, dealt
    by a hash of the row; so neither a label nor a vector that many rows share can fill a task. Only the first entries
    of a cell leave it. Nothing is skipped but what the bounds prove to be out of reach.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label") if _whole(vectors, label_col) else F.xxhash64(label_col).alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector_col).alias("vector"),
        F.col(label_col).isNotNull().alias("_labelled"),
    )
    infinite = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    rows = rows.where(F.col("_labelled") & F.col("vector").isNotNull() & finite).drop("_labelled")
    size = rows.agg(
        F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("largest"),
    ).first()
    width, largest = max(1, size["width"] or 0), scale * (size["largest"] or 0.0) + 1
    kind = "<f4" if largest < 1 << 24 else "<f8"
    finer = tuple(sorted({n for n in levels if n < width} or {1}))
    shape = _Shape(width, finer, kind, kind, largest * largest * width < _EXACT)
    records = stored(
        rows.withColumn("row", F.monotonically_increasing_id())
        .select("row", "id", "label", "anchor", "vector")
        .mapInArrow(_summarise(shape, scale), _RECORD),
        "segments",
    )
    groups = max(1, -(-size["anchors"] // _CELL_ANCHORS))
    # At least as many cells as keep the cluster busy; where they end does not change the result.
    busy = -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // groups)
    deals = max(1, -(-size["rows"] // _CELL_ROWS), min(busy, -(-size["rows"] // _ROWS)))

    def record(source: DataFrame, kind: int, cell: Column) -> DataFrame:
        return source.select(
            cell.cast("long").alias("cell"), F.lit(kind).alias("kind"), "row", "id", "label", "vector", "summary"
        )

    group = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups))
    deal = F.pmod(F.xxhash64("row"), F.lit(deals))
    each_deal, each_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (deals, groups))
    asked = record(
        records.where("anchor").withColumn("_deal", each_deal), _ANCHOR, group * F.lit(deals) + F.col("_deal")
    )
    answers = record(records.withColumn("_group", each_group), _ROW, F.col("_group") * F.lit(deals) + deal)

    def run(parts: list[DataFrame], names: Sequence[str], make: Callable) -> DataFrame:
        together = parts[0]
        for part in parts[1:]:
            together = together.unionByName(part)
        return (
            together.repartition(min(groups * deals, _TASKS), "cell")
            .sortWithinPartitions("cell", "kind")
            .mapInArrow(_cells(shape, names, make), ", ".join(f"{n} long" for n in names))
        )

    names = ["row", "score", "id", "found"]
    found = run([asked, answers], names, lambda side, _: _Positives(side, positives))
    best = stored(_first(found, ["row"], positives).select("row", "place", "score", "id"), "positives")
    # A positive travels to its anchor's cells: its place as the label, its score as the id.
    known = record(
        best.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).select(
            "row", F.col("score").alias("id"), F.col("place").cast("long").alias("label"), "_deal",
            F.lit(None).cast("binary").alias("vector"), F.lit(None).cast("binary").alias("summary"),
        ),
        _POSITIVE,
        group * F.lit(deals) + F.col("_deal"),
    )
    names = ["row", "positive", "score", "id", "found"]
    found = run(
        [asked, known, answers], names,
        lambda side, given: _Negatives(side, given or [np.empty(0, np.int64)] * 3, positives, negatives, low, high),
    )
    mined = _first(found, ["row", "positive"], negatives)
    ids = records.where("anchor").select(F.col("row").alias("_row"), F.col("id").alias("anchor_id"))
    named = F.when(F.col("id") < _MOST, F.col("id"))
    told = best.select(
        F.col("row").alias("_anchor"), F.col("place").alias("_place"), named.alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return (
        mined.join(told, (F.col("row") == F.col("_anchor")) & (F.col("positive") == F.col("_place")))
        .join(ids, F.col("row") == F.col("_row"))
        .select(
            "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), named.alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )


def _whole(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
