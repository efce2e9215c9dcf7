"""Hard negatives against a plain search over all pairs, and the bounds against exact scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolens.llm import hard_negatives as hn
from echolens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row int, cell long, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], SCHEMA).repartition(4)


def plain(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """Every pair, in whole numbers."""
    usable = [
        (i, [math.floor(256 * np.float64(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)
    ]
    out = []
    for n, (i, v, label) in enumerate(usable):
        if i is None or not anchor(i):
            continue
        scored = [
            (-sum(map(int.__mul__, v, w)), math.inf if j is None else j, other == label)
            for m, (j, w, other) in enumerate(usable) if m != n
        ]
        for s, j, _ in sorted((x for x in scored if x[2]), key=lambda x: x[:2])[:positives]:
            near = sorted(x[:2] for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            named = [None if x == math.inf else x for x in (j, *[k for _, k in near])]
            out += [(i, named[0], r, named[r], -s, -t) for r, (t, _) in enumerate(near[:negatives], 1)]
    return sorted(out, key=str)


def mined(df, **more):
    found = hn.hard_negatives(df, anchor=F.col("vec_id") % 5 == 0, **more)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    out = []
    for i in range(160):
        centre = rng.choice(centres)
        out.append((i, [c + rng.gauss(0, 0.6) for c in centre], rng.randrange(3)))
    # Ties, a vector that many rows share, nulls, odd components, lengths of their own, an id twice.
    out += [(200 + i, list(centres[0]), i % 3) for i in range(40)]
    out += [(300, None, 1), (301, list(centres[1]), None), (305, [1.0, None, 2.0], 1), (310, [math.nan] + centres[1][1:], 1)]
    out += [(315, [math.inf, 1.0], 2), (320, [], 1), (325, list(centres[2][:5]), 2), (330, [0.0] * 12, 0), (None, list(centres[3]), 1)]
    return out + [(400, list(centres[4]), 1), (400, list(centres[4]), 1), (405, [-x for x in centres[4]], 2)]


def test_equals_a_search_over_all_pairs(spark, rows, monkeypatch):
    wanted = plain(rows, lambda i: i % 5 == 0)
    assert len(wanted) > 100
    assert mined(frame(spark, rows)) == wanted
    # Other segments, small cells and blocks change nothing.
    for name, value in (("_CELL_ANCHORS", 9), ("_CELL_ROWS", 30), ("_ANCHORS", 4), ("_ROWS", 7)):
        monkeypatch.setattr(hn, name, value)
    assert mined(frame(spark, rows), levels=(1, 2, 5, 9)) == wanted
    narrow = plain(rows, lambda i: i % 5 == 0, 2, 1, 80, 90)
    assert mined(frame(spark, rows), positives=2, negatives=1, low=80, high=90) == narrow


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 10.0**rng.randint(0, 6))) for _ in range(5)], i % 2) for i in range(40)]
    assert mined(frame(spark, rows)) == plain(rows, lambda i: i % 5 == 0)
    rows = [(i, [float(np.float32(rng.uniform(0.5, 1) * 1e5)) for _ in range(3)] + [2e5 * (i % 3)], i % 2) for i in range(30)]
    assert mined(frame(spark, rows)) == plain(rows, lambda i: i % 5 == 0)


def test_bounds_hold_and_get_closer():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(60, 23)))
    shape = hn._Shape(23, (1, 3, 7, 16), "<f4", "<f4", True)
    side = hn._Side(shape, np.arange(60), np.zeros(60), x.astype("<f4"), hn._summary(x, shape))
    exact, wide = x @ x.T, np.inf
    for k in range(4):
        means, deviations = side.level(k)
        middle, span = means @ means.T, deviations @ deviations.T + hn._SLACK * side.norm[:, None] * side.norm
        assert (exact <= middle + span).all() and (exact >= middle - span).all()
        assert span.mean() < wide
        wide = span.mean()


def test_empty_and_without_anchors(spark, rows):
    assert mined(frame(spark, rows[:3]).where(F.lit(False))) == []
    assert mined(frame(spark, [r for r in rows if r[0] and r[0] % 5])) == []
    assert mined(frame(spark, [(5, [1.0], 1)])) == []


def test_query_equals_a_search_over_all_pairs(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_hard_negatives"](spark, sf).collect()), key=str)
    assert got == plain(rows, lambda i: i % 50 == 0)
