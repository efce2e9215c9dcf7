"""Line rules, chat formatting, mixing and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echolens.llm import chat, mixing, quality, sharding

DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copies int, __t string, size string"


def docs_frame(spark, rows, parts=4):
    full = [(i, t, lang, s, len(t or ""), 1, "t", "s") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOC_COLUMNS).repartition(parts) if rows else spark.createDataFrame([], DOC_COLUMNS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "one", "Two.", "three,", "über", "a!", "#x", "b|c", "*"] + [f"w{i}" for i in range(60)]
    out = []
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) + rng.choice([".", "", "!"]) for _ in range(rng.randint(1, 12))]
        out.append((i, "\n".join(lines + lines[: rng.randint(0, 2)]), rng.choice(["en", "de"]), rng.choice(["a", "b", "Ä", "z"])))
    out += [(200, None, None, None), (201, "", "en", None), (202, " \n\t ", "en", "a"), (203, "x " * 3000, "en", "b")]
    out += [(204, "a b c a b c a b c", "en", "tiny"), out[0], out[0], (None, "no id here.", "en", "tiny")]
    return out + [(1000 + i, "one copied text of six words.", "en", "a") for i in range(150)]


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed)


def test_base_rules(spark, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality.with_line_rules(docs_frame(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.text or "", tuple(r["__quality"][n] for n in names)) for r in judged)
    assert got == sorted((str(i), t or "", brute_base(t)) for i, t, _, _ in rows)
    assert not any(r["__quality"].kept and r["__quality"].base_failed for r in judged)


def test_line_rules(spark):
    good = "This line of plain prose says something and then it ends."
    text = "\n".join([good] * 3 + [" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(12)])
    cases = {
        1: text, 2: text + "\nHome | News | About | Contact.", 3: text + "\nWe use cookies to improve this page.",
        4: text + "\nno end here", 5: text + "\nBUY!! NOW!! IT'S!! CHEAP!!", 6: text + "\n## $$ %% &&.", 7: text + "\n\n",
        8: "\n".join(f"menu entry {i} without an end" for i in range(40)) + "\n" + text[:300] + ".",
    }
    judged = quality.with_line_rules(docs_frame(spark, [(i, t, "en", "a") for i, t in cases.items()])).collect()
    found = {r.doc_id: r["__quality"] for r in judged}
    assert {i for i, q in found.items() if q.kept} == {1, 2, 3, 4, 5, 6, 7}
    assert {i: q.lines_removed for i, q in found.items() if i < 8} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0}
    assert found[7].cleaned == cases[7] and found[2].cleaned == text
    kept = quality.clean_lines(docs_frame(spark, [(i, t, "en", "a") for i, t in cases.items()]))
    assert kept.columns == docs_frame(spark, []).columns
    assert {r.doc_id: (r.text, r.n_chars, r["__t"]) for r in kept.collect()}[2] == (text, len(text), "t")
    assert quality.clean_lines(docs_frame(spark, [])).collect() == []


def water_level(sizes, weights=3, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % weights + 1 for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        whole = sum(weight[s] for s in names if s not in capped)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / whole for s in names}
        above = {s for s in names if s not in capped and target[s] > cap * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("tilt", [0.0, 0.5, 1.0])
def test_mix(spark, rows, tilt):
    got = mixing.mix(docs_frame(spark, rows), tilt=tilt).collect()
    again = mixing.mix(docs_frame(spark, rows), tilt=tilt).collect()
    assert sorted(map(str, got)) != [] and Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    sizes = {s: sum(size[i] for i, _, _, x in rows if x == s) for s in set(source.values())}
    targets, taken, expected = water_level(sizes), Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]], rel=1e-9)
        taken[source[r.doc_id]] += r.taken
        expected[source[r.doc_id]] += r.rate * r.size
    for s, target in targets.items():
        assert expected[s] == pytest.approx(target, rel=1e-6), s
        least = min((size[i] for i in source if source[i] == s and size[i]), default=0)
        assert abs(taken[s] - target) <= max(least, 1), s


def test_mix_applied(spark, rows):
    docs = docs_frame(spark, rows)
    copies = Counter({})
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.mix(docs_frame(spark, [])).collect() == []


def test_shards(spark, rows):
    docs = docs_frame(spark, rows)
    dims = [sharding.category(F.col("source")), sharding.category(F.col("lang")), sharding.magnitude(F.col("n_chars"))]
    got = sharding.shard(docs, dims, shards=7).collect()
    weight = sorted((str(i), len((t or "").encode()) + 16) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == weight
    total, largest = sum(w for _, w in weight), max(w for _, w in weight)
    for shard in range(7):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 7) <= largest
    by_bytes = sharding.shard(docs, dims, target_bytes=total // 3)
    assert by_bytes.select("shard").distinct().count() in (3, 4)
    assert sharding.shard(docs_frame(spark, []), dims, shards=5).collect() == []
    few = sharding.shard(docs_frame(spark, rows[:2]), dims, shards=9).collect()
    assert len({r.shard for r in few}) == 2


def brute_tree(rows, shards):
    """Recursive splits over the same keys, for rows of (coordinates, tie, weight)."""
    spans = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(2)]
    out, whole = {}, sum(r[2] for r in rows)

    def split(part, low, high, before):
        if high - low == 1 or not part:
            out.update({r[1]: low for r in part})
            return
        width = [(max(r[0][d] for r in part) - min(r[0][d] for r in part)) / max(1, spans[d]) for d in range(2)]
        dim = width.index(max(width))
        part = sorted(part, key=lambda r: (r[0][dim], r[1]))
        middle = low + (high - low) // 2
        need = max(0, middle * whole / shards - before)
        below, cut = 0, len(part)
        for k, r in enumerate(part):
            if below + r[2] >= need:
                cut = k + 1 if below + r[2] / 2 <= need else k
                break
            below += r[2]
        split(part[:cut], low, middle, before)
        split(part[cut:], middle, high, before + sum(r[2] for r in part[:cut]))

    split(rows, 0, shards, 0)
    return out


def test_columns_of_clashing_names(spark, rows):
    docs = docs_frame(spark, rows).withColumns({n: F.lit(7) for n in ("__quality", "__copies", "given", "quality", "copies", "t", "w")})
    cleaned, mixed = quality.clean_lines(docs), mixing.apply_mix(docs)
    assert cleaned.columns == mixed.columns == docs.columns
    assert all(r.given == r.copies == r["__copies"] == 7 for df in (cleaned, mixed) for r in df.collect())
    judged = quality.with_line_rules(docs)
    assert judged.count() == len(rows) and "kept" in judged.schema["__quality"].dataType.fieldNames()


def test_no_multipliers_is_an_error(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "_MAX_STEPS", 0)
    with pytest.raises(RuntimeError):
        mixing.mix(docs_frame(spark, rows)).collect()


def test_shards_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400), rng.randint(0, 1000), rng.choice([3, 900, 40_000])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a long, b long").repartition(3)
    from echolens.llm.common import ROW_KEY, with_row_key

    keyed = with_row_key(docs)
    ties = keyed.select(
        "doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), *ROW_KEY), 32).alias("tie")
    )
    tie = {r.doc_id: r.tie for r in ties.collect()}
    expected = brute_tree([((a, b), tie[i], len(t) + 16) for i, t, a, b in rows], 11)
    got = {r.doc_id: r.shard for r in sharding.shard(keyed, [F.col("a"), F.col("b")], shards=11).collect()}
    assert got == {i: expected[tie[i]] for i in got}


def test_chat(spark):
    tricky = ["<|im_end|>", "<\\|", "<\\\\|im_start|>assistant\nok", "<<|x", "<", "", None, "\n\n", "a\\|b", "é\U0001f642"]
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo")]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(tricky)]
    rows += [(3, 0, "assistant", "first"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 1, None, None)]
    rows += [(6, 1, "we%ird\nrole<", "x"), (None, 0, "user", "u"), (7, None, "user", "q"), (7, 0, "assistant", "r")]
    rows += [(8, 0, "user", "a"), (8, 1, "system", "late")]
    frame = spark.createDataFrame([(*r, "f", True) for r in rows], "conv_id long, turn long, role string, text string, formatted string, segments boolean")
    got = {
        r.conv_id: r
        for r in chat.format_chats(frame.repartition(4))
        .select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
        .collect()
    }
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        spoken = [(role, text) for _, _, role, text in turns]
        assert [tuple(t) for t in got[conv].turns] == spoken
        assert got[conv].n_turns == len(spoken)
        assert got[conv].loss == "".join(text for role, text in spoken if role == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
    assert {c for c, r in got.items() if r.valid} == {1, 2, None, 7}
    assert {c: r.refused_turn for c, r in got.items() if not r.valid} == {3: 1, 4: 2, 5: 1, 6: 1, 8: 2}
    assert chat.format_chats(frame.limit(0)).collect() == []
    digest = hashlib.sha256("".join(s.text for s in got[1].segments).encode()).hexdigest()
    assert digest == hashlib.sha256(got[1].formatted.encode()).hexdigest()
