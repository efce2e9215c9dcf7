"""The Merkle manifest against a plain recursive tree."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from echolens.llm import merkle
from echolens.llm.queries import QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, _group int, root string, leaf int, _place int, _node int"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tampered(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0


def lowered(row):
    return (*row[:4], row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def levels(nodes, n):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + n])) for i in range(0, len(out[-1]), n)])
    return out


def climb(tree, i, node, n):
    """Siblings of node ``i`` on the way up, and what the way gives when it holds ``node``."""
    beside = []
    for row in tree[:-1]:
        run = row[i - i % n : i - i % n + n]
        beside += run[: i % n] + run[i % n + 1 :]
        node = digest("".join([*run[: i % n], node, *run[i % n + 1 :]]))
        i //= n
    return beside, node


def plain(rows, n=8):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]], n) for g in order}
    top = levels([trees[g][-1][0] for g in order], n)
    out = []
    for k, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            node = leaf(lowered(row)) if tampered(row) else leaf(row)
            below, subroot = climb(trees[g], i, node, n)
            above, root = climb(top, k, subroot, n)
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], digest("".join(below + above)), root))
    return sorted(out, key=str)


def found(spark, rows, parts=4, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.merkle_manifest(df, FIELDS, tampered=hit, replaced={"text": low}, **more)


def told(manifest):
    names = ["_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return sorted((tuple(r) for r in manifest.verified().select(names).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    langs = ["en"] * 6 + ["de", None, "", "é", "zz"]
    out = [(7 * i % 500, f"s{i % 3}", langs[i * i % 11], i % 9 or None, f"Text ÄB {i}") for i in range(500)]
    out += [(1000 + i, None, f"l{i}", None, None) for i in range(9)]
    return out + [out[3], out[3], (None, "a", "en", 1, "X"), (None, "a", "en", 1, "Y"), (2000, "", "de", 0, ""), (3, "b", "en", 5, "Other")]


def test_equals_a_plain_tree(spark, rows):
    got = told(found(spark, rows))
    assert got == plain(rows)
    assert len({r[3] for r in got}) == 1 and any(r[5] != r[3] for r in got)


@pytest.mark.parametrize("fan_out, height", [(2, 2), (3, 1), (8, 1)])
def test_blocks_over_several_rounds(spark, rows, fan_out, height):
    assert told(found(spark, rows, shape=merkle.Shape(fan_out, height))) == plain(rows, fan_out)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert told(found(spark, rows)) == (plain(rows) if rows else [])
    assert told(found(spark, rows, shape=merkle.Shape(8, 1))) == (plain(rows) if rows else [])


def test_versions_copy_their_ancestors_only(spark, rows):
    manifest = found(spark, rows, shape=merkle.Shape(3, 2))
    copies = manifest.copied_nodes().collect()
    verified = manifest.verified().collect()
    changed = {r._id: r for r in verified if r.changed_leaf}
    assert {c.version for c in copies} == set(changed) == {r[0] for r in rows if tampered(r)}
    tops = {}
    for c in copies:
        tops[c.version] = max(tops.get(c.version, (0, "")), (c.level, c.digest))
    assert all(tops[v][1] == r.folded_root for v, r in changed.items() if v != 3)
    assert len(copies) <= 12 * sum(1 for r in verified if r.changed_leaf)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(FIELDS).collect()]
    got = QUERIES["op12_merkle_versions"](spark, sf).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == plain(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}
