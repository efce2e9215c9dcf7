"""Exact and near deduplication against brute force, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from echolens.llm import exact_dedup, simhash
from echolens.llm.components import connected_components

COLUMNS = "doc_id long, text string, keep_id string, _print int, kept string, _run int"


def frame(spark, rows, parts=5):
    full = [(i, t, "x", 1, "y", 2) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(parts) if rows else spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = [f"{rng.choice('abcdefg')}{rng.choice('lmnop')}{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    out = list(base)
    for text in base[:30]:  # near copies with one word changed
        w = text.split()
        w[rng.randrange(len(w))] = "other"
        out.append(" ".join(w))
    out += [base[3].upper(), "  " + base[4] + "\t", base[5], base[5], base[5]]
    out += [None, "", None, " \n", "one", "ONE", "one two", "long " * 30_000]
    rows = list(enumerate(out))
    return rows + [rows[0], rows[0], (None, base[1]), (None, "alone with no id"), (-5, base[2])]


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_copies(spark, texts, fan_in):
    got = exact_dedup.exact_copies(frame(spark, texts), fan_in=fan_in).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    kept = {}
    for row in got:
        kept[row.text_sha256] = kept.get(row.text_sha256, 0) + row.kept
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)
    seen = sorted((r.text_sha256, r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in got)
    expected = sorted(
        (hashlib.sha256(t.encode()).hexdigest(), i is None, i or 0, max((x for x in ids if x is not None), default=None), len(ids))
        for t, ids in groups.items() for i in ids
    )
    assert seen == expected


def test_exact_copies_dropped(spark, texts):
    docs = frame(spark, texts)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.schema == docs.schema
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in texts})


def brute_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies(spark, texts):
    rows = [(i, t) for i, t in texts if t is None or len(t) < 100_000] + [(9_999, "long " * 5_000)]
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                parent[find(a)] = find(b)
    members = {}
    for k, (i, _) in enumerate(rows):
        members.setdefault(find(k), []).append(i)
    expected = sorted(
        (f"{prints[k]:016x}", i is None, i or 0, min((x for x in members[find(k)] if x is not None), default=None) or 0)
        for k, (i, _) in enumerate(rows)
    )
    got = simhash.near_copies(frame(spark, rows)).collect()
    assert sorted((r.fingerprint, r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in got) == expected
    assert sum(r.kept for r in got) == len(members)


def test_near_copies_dropped(spark):
    docs = frame(spark, [(3, "a b c d e"), (1, "A b c\td e"), (2, "quite another text here"), (1, "A b c\td e")])
    left = simhash.drop_near_copies(docs)
    assert left.schema == docs.schema
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_no_documents(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_copies(empty).collect() == []
    assert simhash.near_copies(empty).collect() == []


def test_anchors_meet():
    """Halves that differ in at most one bit share an anchor, and every anchor is within distance two."""
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 1 << 32, 2_000, np.uint32)
    near = simhash.anchors(halves)
    assert int(np.bitwise_count(near ^ halves[:, None]).max()) == 2
    for bit in range(32):
        other = simhash.anchors(halves ^ np.uint32(1 << bit))
        assert all(np.intersect1d(a, b).size for a, b in zip(near[:200], other[:200]))


def test_spanning_reaches_chains():
    members = np.array([0, 7, 63, 511, 255 << 40, (255 << 40) + 1], np.uint64)
    trees = {int(root): sorted(map(int, found)) for found, root in simhash._spanning(members)}
    assert trees == {0: [7, 63, 511], 255 << 40: [(255 << 40) + 1]}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 60)] + [(5, 5), (200, 201), (201, 200)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"))
    found = {r.node: r.component for r in got.collect()}
    assert got.count() == len(found)
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_large_anchors_are_compared_by_pairs_of_blocks(spark, texts, monkeypatch):
    near = [(1000 + i, " ".join(f"w{(7 * k + (k == 5 * i)) % 50}" for k in range(400))) for i in range(40)]
    docs = frame(spark, texts + near)

    def found():
        return sorted(map(str, simhash.near_copies(docs).select("doc_id", "fingerprint", "component_id", "kept").collect()))

    whole = found()
    monkeypatch.setattr(simhash, "_ANCHOR_PRINTS", 2)
    assert found() == whole
