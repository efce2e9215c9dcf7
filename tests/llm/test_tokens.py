"""Token counts, packing and training order against the tokenizer library itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echolens.llm import packing, token_counts, training_order
from echolens.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, content string, shard int, ids string, _task int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "on", "Éa", "ßen", "tion.", "x-y", "don't", "(a)", "12", "中文字", "\U0001f642"] + [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 900, 2500]))) for _ in range(40)]
    out += [None, "", " ", "a  b\n\n c\t d ", "<|endoftext|> x<|endoftext|>", out[0], out[0], "nospace" * 4000, "word " * 20_000]
    rows = list(enumerate(out))
    return rows + [rows[0], (None, "no id"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, "i", 2) for i, t in rows], COLUMNS).repartition(3)


def test_pieces_equal_the_library(library):
    encoder, rng = PieceEncoder(PATH), random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", " \n", "\xa0", "<|endoftext|>", "'s", "1", "é", "中", "!", "\x1c", "\x85",
                "᠎", "don't", "\r\n", "\U0001f642", "　", "x y"]
    alphabet += [",", ".", "?!", "ab.", "\u0301", "\u02bc", "½", "\xad", "'re'll", "_", "ß"]
    latin = [chr(c) for c in range(1, 0x250)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice(latin) for _ in range(rng.randint(1, 9))) for _ in range(3)) for _ in range(4000)]
    for start in range(0, len(texts), 40):
        part = texts[start : start + 40]
        for text, ids in zip(part, encoder.ids_of(part)):
            assert list(ids) == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.ranks is not None and len(encoder.cache) > 100


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr("echolens.llm.tokens._CACHE_PIECES", 20)
    monkeypatch.setattr("echolens.llm.tokens._SLICE", 7)
    encoder, rng = PieceEncoder(PATH), random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 99)}," if i % 3 else f" x{i}" for i in range(rng.randint(2, 60))) for _ in range(60)]
    for text, ids in zip(texts, encoder.ids_of(texts)):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, encoder, rng = Tokenizer.from_file(path), PieceEncoder(path), random.Random(4)
    assert encoder.quick is not None and not encoder.cuttable
    alphabet = [chr(c) for c in range(1, 0x250)] + [" ", "'s", "'re", "\n", "It", "THE", "12", "_", "...", "don't"] * 20
    odd = ["\u0301", "e\u0301", "Σας", "中文", "\u200b", "\xa0", "<|endoftext|>", "<|startoftext|>", "\U0001f642", "\t", "  "]
    texts = ["Some Words  here", " x", "", "a\nb", "Plain “quoted” words, and a <|endoftext|> mark", "x " * 20_000, "y" * 5_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(alphabet + odd * 20) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.ids_of(texts)):
        assert list(ids) == other.encode(text, add_special_tokens=False).ids, repr(text)
    # The faster library takes a whole word that it knows for one token; the vocabulary must say the same.
    known = [other.decode([i]) for i in range(512, other.get_vocab_size(), 7)]
    assert all(list(encoder.ids(w)) == other.encode(w, add_special_tokens=False).ids for w in known)


def test_plain_texts_take_the_faster_library(library):
    encoder = PieceEncoder(PATH)
    for text in ("Plain words, no pairs of blanks.\nNext line", "é ß 12 x_y don't '", "ends with a blank "):
        assert encoder.quick(text) == library.encode(text, add_special_tokens=False).ids
    assert all(encoder.quick(text) is None for text in ("two  blanks", "a \n", "“q”", "tab\t", "x<|endoftext|>"))


def test_counts_and_cache(spark, texts, library, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    expected = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)

    def counts(rows):
        got = token_counts.token_counts(frame(spark, rows), PATH, cache).collect()
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got)

    assert counts(texts) == expected
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in texts})
    more = [*texts, (77, "a new text"), (78, "a new text")]
    assert len(counts(more)) == len(more)
    assert spark.read.parquet(cache).count() == stored + 1
    other = token_counts.token_counts(frame(spark, texts[:3]), public_tokenizers.path("word_bpe_49k.json"), cache)
    assert other.count() == 3 and spark.read.parquet(cache).count() == stored + 4
    # Many misses are found another way than a few; nothing is encoded again.
    monkeypatch.setattr(token_counts, "_BROADCAST_DIGESTS", 1)
    assert counts([*more, *[(100 + i, f"other {i} text") for i in range(9)]])[: len(expected)] == counts(more)[: len(expected)]
    assert spark.read.parquet(cache).groupBy("tokenizer", "content").count().where("count > 1").count() == 0
    empty = token_counts.token_counts(frame(spark, texts).limit(0), PATH, str(tmp_path / "none"))
    assert empty.collect() == []


def test_packing_covers_every_id_once(spark, texts, library):
    pieces = packing.pack_documents(frame(spark, texts), PATH, shard_rows=16).collect()
    whole = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in texts]
    wanted = sorted(ids.tobytes() for ids in whole)
    # Rows may repeat, so pieces are put together by id, then compared as a multiset of ids per document id.
    for doc in {i for i, _ in texts}:
        given = sorted(x for (i, _), ids in zip(texts, whole) if i == doc for x in enumerate(ids.tolist()))
        found = sorted(
            (p.start + k, int(x)) for p in pieces if p.doc_id == doc for k, x in enumerate(np.frombuffer(p.ids, "<u4"))
        )
        assert found == given
    assert len(wanted) == len(texts)
    sequences = {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for line in sequences.values():
        line.sort()
        assert [o for o, _ in line] == [sum(n for _, n in line[:k]) for k in range(len(line))]
        assert sum(n for _, n in line) <= 1024
    tokens = sum(map(len, whole))
    assert 1024 * len(sequences) - tokens <= 1024 * 5
    assert packing.pack_documents(frame(spark, texts).limit(0), PATH).collect() == []


def test_neighbours_come_first():
    """A seed is followed by the rest that shares its rare terms."""
    rests = [np.array([1, 2, 50, 51, 52], "<u4"), np.array([1, 2, 60, 61], "<u4"), np.array([1, 2, 50, 52, 70], "<u4")]
    lines = list(packing.fill_windows(rests, 10))
    assert [doc for doc, _, _ in lines[0]] == [0, 2]
    lines = list(packing.fill_windows(rests, 8))
    assert lines == [[(0, 0, 5), (2, 0, 3)], [(1, 0, 4), (2, 3, 2)]]


def test_tiny_neighbours_fill_a_window():
    """Fifty tiny related rests share a window, though as many others lie between them in order."""
    rests = [np.array([7 + i % 2, 100 + i, 300 + i, 0], "<u4") for i in range(100)]
    lines = list(packing.fill_windows(rests, 200))
    assert [sorted(doc for doc, _, _ in line) for line in lines] == [list(range(0, 100, 2)), list(range(1, 100, 2))]


def test_neighbours_beyond_the_rarest_terms():
    """A seed whose rarest terms lead to used rests only is looked up by its other terms."""
    rare = list(range(100, 124))
    rests = [np.array(x, "<u4") for x in ([*rare, 200], rare, [200, 300], [200, 301], [302])]
    index = packing._Index(rests)
    used = np.array([True, True, False, False, False])
    assert sorted(index.neighbours(index.question(rests[0]), used).tolist()) == [2, 3]
    assert index.neighbours(index.question(rests[0]), np.array([True, True, True, True, False])).tolist() == []


def test_index_ranks_as_plain_bm25():
    rng = random.Random(6)
    rests = [np.array([rng.choice(range(30)) for _ in range(rng.randrange(1, 12))], "<u4") for _ in range(60)]
    index, mean = packing._Index(rests), sum(map(len, rests)) / len(rests)
    frequency = {t: sum(t in r for r in rests) for t in range(30)}
    for seed in range(0, 60, 7):
        used = np.array([i == seed or i % 11 == 3 for i in range(60)])
        scores = {}
        for i, r in enumerate(rests):
            for t in set(rests[seed].tolist()) & set(r.tolist()):
                idf = np.log1p((60 - frequency[t] + 0.5) / (frequency[t] + 0.5))
                tf = r.tolist().count(t)
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r) / mean))
        wanted = sorted((-round(s, 9), i) for i, s in scores.items() if not used[i])
        got = index.neighbours(index.question(rests[seed]), used).tolist()
        assert [(-round(scores[i], 9), i) for i in got] == wanted[:16]


def test_common_routes_are_dealt_over_tasks(spark):
    """Copies, which share all their ids, and documents of their own, in tasks of ten."""
    rows = [(i, 5 << 24 | 7, i, b"x") for i in range(95)] + [(100 + i, (6 + i) << 24, 0, b"x") for i in range(40)]
    rests = spark.createDataFrame(rows, "doc_id long, _route long, start long, ids binary")
    dealt = packing._dealt(rests, 10).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("doc_id").alias("d")).collect()
    assert sorted(x for r in dealt for x in r.d) == sorted(r[0] for r in rows)
    assert max(len(r.d) for r in dealt) < 25 and all(len(r.d) <= 10 for r in dealt if min(r.d) >= 100)
    assert all(max(r.d) < 95 or min(r.d) >= 100 for r in dealt)


def plain_permute(x, domain, key):
    """The same network over whole numbers."""
    half = max(1, -(-max(1, (domain - 1).bit_length()) // 2))
    keys = np.random.default_rng(key).integers(0, 1 << 63, 6, np.uint64).tolist()
    whole, mask = (1 << 64) - 1, (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in keys:
            y = (right + k) * 0x9E3779B97F4A7C15 & whole
            y ^= y >> 29
            y = y * 0xBF58476D1CE4E5B9 & whole
            left, right = right, left ^ ((y ^ y >> 32) & mask)
        x = left << half | right
        if x < domain:
            return x


def test_order_equals_a_plain_permutation(spark, texts, library, tmp_path):
    out, docs = str(tmp_path / "shards"), frame(spark, texts)
    training_order.write_training_order(docs, PATH, out, window=64, shards=5, key=3)
    tasks = {}
    for r in docs.select("doc_id", "text", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("n")).collect():
        tasks.setdefault(r.task, []).append((r.n, r.doc_id, r.text))
    wanted = []
    for task, found in tasks.items():
        n = 0
        for _, doc, text in sorted(found, key=lambda x: x[0]):
            size = len(library.encode(text or "", add_special_tokens=False).ids) + 1
            for start in range(0, size, 64):
                wanted.append((plain_permute(task << 33 | n, 3 << 33, 3), doc, start, min(64, size - start)))
                n += 1
    read = training_order.read_training_order(spark, out, window=64).orderBy("slot").collect()
    assert [(r.doc_id, r.start, r.length) for r in read] == [x[1:] for x in sorted(wanted, key=lambda x: x[0])]
    shards = [r.shard for r in read]
    assert shards == sorted(shards) and len(set(shards)) == 5


@pytest.mark.parametrize("total, shards", [(0, 1), (1e6, 1), (160e6, 10), (65e9, 4062), (1e15, 3_906_250)])
def test_shards_follow_the_bytes(total, shards):
    assert training_order.shard_count(total) == shards


@pytest.mark.parametrize("domain", [1, 2, 3, 100, 4096, 5000])
def test_permutation_is_one_to_one(domain):
    out = training_order.permute(np.arange(domain, dtype=np.uint64), domain, 9)
    assert sorted(out.tolist()) == list(range(domain))


def test_training_order_round_trip(spark, texts, library, tmp_path):
    out = str(tmp_path / "shards")
    training_order.write_training_order(frame(spark, texts), PATH, out, window=128, shards=9)
    read = training_order.read_training_order(spark, out, window=128).orderBy("slot").collect()
    assert [r.slot for r in read] == list(range(len(read)))
    assert len({r.shard for r in read}) > 3
    for doc in {i for i, _ in texts}:
        given = sorted(
            x for i, t in texts if i == doc for x in enumerate([*library.encode(t or "", add_special_tokens=False).ids, 0])
        )
        found = sorted((r.start + k, int(x)) for r in read if r.doc_id == doc for k, x in enumerate(np.frombuffer(r.ids, "<u4")))
        assert found == given
    later = training_order.read_training_order(spark, out, window=128, from_slot=57).orderBy("slot").collect()
    assert later == read[57:]
    places = [r.slot for r in read if r.doc_id == 48]  # a long document is spread over the whole order
    assert np.std(places) > len(read) / 5
    none = str(tmp_path / "none")
    training_order.write_training_order(frame(spark, texts).where(F.lit(False)), PATH, none)
    assert training_order.read_training_order(spark, none).collect() == []
