"""Vector best-fit packing against a piece-by-piece version, its constraints and the tokenizer library."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echolens.llm import vector_packing as vp
from echolens.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece int, ids string, _filled int, sequence_id int"


def one_by_one(lengths, capacity, weights, rule):
    """The same rule, a piece at a time over all bins."""
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = [lengths[i], 1, lengths[i] * (lengths[i] + 1) // 2]
        best, least = None, math.inf
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                if rule == "norm":
                    score = sum(((x - y) / c) ** 2 * w for x, y, c, w in zip(left, need, capacity, weights))
                else:
                    score = sum((x / c) * (y / c) * w for x, y, c, w in zip(left, need, capacity, weights))
                if score < least - 1e-12:
                    best, least = b, score
        if best is None:
            best = len(bins)
            bins.append(list(capacity))
        bins[best] = [x - y for x, y in zip(bins[best], need)]
        out[i] = best
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@settings(deadline=None, max_examples=60)
@given(lengths=st.lists(st.integers(1, 64), max_size=120), documents=st.integers(1, 9), cost=st.integers(2080, 4000))
def test_equals_a_piece_at_a_time(rule, lengths, documents, cost):
    capacity, weights = (64, documents, cost), (1.0, 0.25, 0.5)
    assert vp.best_fit(np.array(lengths, np.int64), capacity, weights, rule).tolist() == one_by_one(lengths, capacity, weights, rule)


def test_every_constraint_binds():
    lengths = np.array([40, 30, 30, 20, 10, 10, 5, 5, 1, 1, 1])
    for capacity in ((64, 64, 10**6), (64, 2, 10**6), (64, 64, 900), (64, 3, 850)):
        used = np.zeros((len(lengths), 3), np.int64)
        np.add.at(used, vp.best_fit(lengths, capacity), vp.needs(lengths))
        assert (used <= capacity).all()
    with pytest.raises(ValueError):
        vp.best_fit(lengths, (39, 9, 10**6))


def check(rows, texts, library, window, most=None):
    """Every id once, in sequences without gaps and within the window; the number of sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and len(parts) <= (most or window)
    found = {}
    for r in rows:
        assert r.start == r.piece * window and len(r.ids) == 4 * r.length
        found.setdefault(r.doc_id, []).append((r.piece, r.ids))
    wanted = {}
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.setdefault(i, []).extend((k, ids[s : s + window].tobytes()) for k, s in enumerate(range(0, len(ids), window)))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    return len(sequences)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "ON", "Éa", "tion.", "x-y", "don't", "(a)", "12", "中文字", "“q”"] + [f"w{i}" for i in range(90)]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 60, 200]))) for _ in range(200)]
    rows = list(enumerate([*out, None, "", out[0], out[0], "nospace" * 3000, "word " * 5000]))
    return [*rows, rows[0], (None, "no id"), (None, "no id")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "i", 2, 3) for i, t in rows], SCHEMA).repartition(parts)


def test_documents(spark, texts, library):
    rows = vp.pack_best_fit(frame(spark, texts), PATH, window=128).collect()
    assert rows[0].__fields__ == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    n = check(rows, texts, library, 128)
    assert n <= 1.01 * sum(r.length for r in rows) / 128 + 1
    for parts in (1, 40):
        assert check(vp.pack_best_fit(frame(spark, texts, parts), PATH, window=128).collect(), texts, library, 128) <= n + 2


def test_more_constraints(spark, texts, library):
    rows = vp.pack_best_fit(frame(spark, texts), PATH, window=128, max_documents=3, rule="dot").collect()
    check(rows, texts, library, 128, most=3)
    # A whole piece of 128 costs 8,256; two of 64 cost 4,160 only.
    rows = vp.pack_best_fit(frame(spark, texts), PATH, window=128, max_attention=8_256).collect()
    cost = {}
    for r in rows:
        cost[r.sequence_id] = cost.get(r.sequence_id, 0) + r.length * (r.length + 1) // 2
    assert max(cost.values()) <= 8_256


def test_empty_table_and_small_shards(spark, texts, library, monkeypatch):
    assert vp.pack_best_fit(frame(spark, texts).where(F.lit(False)), PATH).collect() == []
    monkeypatch.setattr(vp, "_SHARD_PIECES", 7)
    check(vp.pack_best_fit(frame(spark, texts), PATH, window=128).collect(), texts, library, 128)


def test_query(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op13_vector_best_fit"](spark, sf).collect()
    crcs = {}
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        crcs |= {(i, k): (len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in rows} == crcs and len(rows) == len(crcs)
    total = sum(n for n, _ in crcs.values())
    assert len({r.sequence_id for r in rows}) <= math.ceil(1.005 * total / 2048) + 1
