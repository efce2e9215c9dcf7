"""One large JSON document, the elements of an array member read by several tasks.

A document is read in byte ranges, cut at closing braces. What a range does to whoever reads on is small: for each state
in which it may begin (outside of a string, inside, behind a backslash) the state in which it ends, and by how much the
depth of brackets changes. These effects are put together range by range, so every range learns where it stands, cuts
the elements that begin and end in it, and leaves what reaches over its borders, one element each, to be joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolens.session import store

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_IN_STRING = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_MARKS = re.compile(r'["{}\[\],:]')
_SENT_RANGES = 100_000
_EFFECT = "file string, range bigint, bytes bigint, size bigint, " + ", ".join(f"end{s} int, depth{s} bigint" for s in range(3))
_START = "file string, range bigint, state int, depth bigint, last boolean, closed boolean"
_PIECE = (
    "file string, range bigint, no bigint, kind string, member string, begun boolean, ended boolean, text string"
)


def scan(text: str, state: int) -> Iterator[tuple[int, str]]:
    """Places of brackets, commas, colons and opening quotes outside of strings; last, (length, state at the end)."""
    at, end = 0, len(text)
    while at < end or state == INSIDE:
        if state == ESCAPED:
            at, state = at + 1, INSIDE
        elif state == INSIDE:
            at = _IN_STRING.match(text, at).end()
            if at >= end:
                break
            if text[at] == "\\":  # the last character, and what it escapes is not here
                at, state = end, ESCAPED
                break
            at, state = at + 1, OUTSIDE
        else:
            found = _MARKS.search(text, at)
            if not found:
                break
            yield found.start(), found[0]
            at = found.end()
            if found[0] == '"':
                state = INSIDE
    yield end, str(state)


def _effects(batches: Iterator) -> Iterator:
    """What each range does to the state and the depth, from any state."""
    import pyarrow as pa

    found: dict[tuple, list] = {}
    for batch in batches:
        for file, start, size, value in zip(*[batch.column(c).to_pylist() for c in ("file", "range", "size", "value")]):
            held = found.setdefault((file, start), [0, size, *[x for s in range(3) for x in (s, 0)]])
            text = value + "}"
            held[0] += len(text.encode())
            known: dict[int, tuple[int, int]] = {}
            for s in range(3):
                state = held[2 + 2 * s]
                if state not in known:
                    depth, end = 0, state
                    for _, mark in scan(text, state):
                        if mark in "{[":
                            depth += 1
                        elif mark in "}]":
                            depth -= 1
                        elif mark in "012":
                            end = int(mark)
                    known[state] = end, depth
                held[2 + 2 * s] = known[state][0]
                held[3 + 2 * s] += known[state][1]
    rows = [(*key, *held) for key, held in found.items()]
    names = [part.split()[0] for part in _EFFECT.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.int32(), pa.int64()] * 3]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _starts(ranges):
    """State and depth at the start of each range of a file; the last range also says whether it ends with a brace."""
    import pandas as pd

    ranges = ranges.sort_values("range")
    state, depth, out = OUTSIDE, 0, []
    over = int(ranges["bytes"].sum() - ranges["size"].iloc[0])
    for k, row in enumerate(ranges.itertuples(index=False)):
        last = k == len(ranges) - 1
        out.append((row.file, row.range, state, depth, last, over == 0))
        depth += int(getattr(row, f"depth{state}"))
        state = int(getattr(row, f"end{state}"))
    return pd.DataFrame(out, columns=["file", "range", "state", "depth", "last", "closed"])


def _elements() -> Callable:
    """Elements at depth 2, the openings of members and the ends of files, range by range."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made: list[tuple] = []
        at, state, depth, member, no, buffer, begun, waiting = None, 0, 0, None, 0, [], True, []
        names = ["file", "range", "no", "kind", "member", "begun", "ended", "text"]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string())

        def put(kind: str, text: str | None, ended: bool = True) -> None:
            nonlocal no
            made.append((*at, no, kind, member, begun, ended, text))
            no += 1

        def close(last: bool) -> None:
            nonlocal buffer
            if buffer and depth >= 2:
                put("element", "".join(buffer), False)
            buffer = []
            if last:
                put("end", f"{state} {depth}")

        def take(text: str) -> None:
            nonlocal state, depth, member, buffer, begun
            since, key_from = 0, None
            for place, mark in scan(text, state):
                if mark in "012":
                    state = int(mark)
                elif mark in "{[":
                    depth += 1
                    if depth == 1 and mark == "[":
                        put("open", "root")
                    if depth == 2:
                        put("open", mark)
                        since, begun, buffer = place + 1, True, []
                elif mark in "}]":
                    depth -= 1
                    if depth == 1:
                        buffer.append(text[since:place])
                        put("element", "".join(buffer))
                        buffer, begun = [], True
                        since = place + 1
                elif depth == 2 and mark == ",":
                    buffer.append(text[since:place])
                    put("element", "".join(buffer))
                    buffer, begun, since = [], True, place + 1
                elif depth == 1 and mark == '"':
                    key_from = place
                elif depth == 1 and mark == ":" and key_from is not None:
                    try:
                        member = json.loads(text[key_from:place])
                    except ValueError:
                        member = None
                    key_from = None
                elif depth == 1 and mark == ",":
                    member = None
            if depth >= 2:
                buffer.append(text[since:])

        def written() -> pa.RecordBatch:
            columns = list(zip(*made)) if made else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        last = closed = False

        def finish() -> None:
            # A piece is taken when the next one is there, since the last one of a file may have no brace behind it.
            if at is not None:
                for text in waiting:
                    take(text if last and not closed else text + "}")
                close(last)

        columns = ("file", "range", "state", "depth", "last", "closed", "value")
        for batch in batches:
            for file, start, s, d, is_last, is_closed, value in zip(*[batch.column(c).to_pylist() for c in columns]):
                if (file, start) != at:
                    finish()
                    at, state, depth, member, no, buffer, waiting = (file, start), s, d, None, 0, [], []
                    begun, last, closed = d < 2, is_last, is_closed
                for text in waiting:
                    take(text + "}")
                waiting = [value]
            if len(made) >= 10_000:
                yield written()
                made = []
        finish()
        yield written()

    return run


def array_elements(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``ord, element``: the elements of the array member ``name`` of JSON documents, one document per file, as text.

    ``ord`` counts from 0 within a document. A file whose root is not an object with that array, or whose strings and
    brackets do not close, raises an error. Of a member that is there twice the last one counts. Keys of the root must
    not reach over a closing brace.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    pieces = spark.read.option("lineSep", "}").text(path).select(*where, F.col("_metadata.file_size").alias("size"), "value")
    effects = store(pieces.mapInArrow(_effects, _EFFECT), "json-ranges")
    starts = store(effects.groupBy("file").applyInPandas(_starts, _START), "json-starts")
    placed = pieces.withColumn("_piece", F.monotonically_increasing_id())
    if starts.limit(_SENT_RANGES + 1).count() <= _SENT_RANGES:
        placed = placed.join(F.broadcast(starts), ["file", "range"])
    else:
        placed = placed.join(starts, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "_piece")
    cut = placed.select("file", "range", "state", "depth", "last", "closed", "value").mapInArrow(_elements(), _PIECE)
    cut = store(cut, "json-elements")
    # A range that begins inside a member learns its name from the ranges before it.
    by_file = Window.partitionBy("file").orderBy("range", "no")
    opened = cut.where("kind = 'open'").select("file", F.col("range").alias("_r"), F.col("no").alias("_n"), "member", "text")
    found = opened.where((F.col("member") == name) & (F.col("text") == "[")).groupBy("file").agg(
        F.max(F.struct("_r", "_n")).alias("_open")
    )
    following = Window.partitionBy("file").orderBy("_r", "_n")
    spans = (
        opened.withColumn("_next", F.lead(F.struct("_r", "_n")).over(following))
        .join(found, "file")
        .where(F.struct("_r", "_n") == F.col("_open"))
        .select("file", "_open", "_next")
    )
    here = F.struct(F.col("range").alias("_r"), F.col("no").alias("_n"))
    inside = cut.where("kind = 'element'").join(spans, "file").where(
        (here > F.col("_open")) & (F.col("_next").isNull() | (here < F.col("_next")))
    )
    wrong = F.raise_error(F.lit(f"the document has no array member '{name}'")).cast("string")
    files = cut.select("file").distinct()
    ends = cut.where("kind = 'end'").select("file", F.col("text").alias("_end"))
    roots = opened.where("text = 'root'").select("file", F.lit(True).alias("_root")).distinct()
    checked = files.join(spans.select("file", F.lit(True).alias("_there")), "file", "left").join(ends, "file", "left").join(
        roots, "file", "left"
    )
    good = F.col("_there") & (F.col("_end") == "0 0") & F.col("_root").isNull()
    checked = store(checked.select("file", F.when(F.coalesce(good, F.lit(False)), F.lit("")).otherwise(wrong).alias("_ok")), "json-checked")
    parts = inside.withColumn("_element", F.sum(F.col("begun").cast("int")).over(by_file))
    joined = parts.groupBy("file", "_element").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "no", "text"))), lambda x: x["text"]), "").alias("element")
    )
    last = joined.groupBy("file").agg(F.max("_element").alias("_last"))
    # The text between the brackets of an empty array is no element; an empty one among others is left to the parser.
    some = joined.join(last, "file").where((F.col("_last") > 1) | (F.trim(F.col("element"), F.lit(" \t\r\n")) != ""))
    return some.join(checked, "file").select((F.col("_element") - 1).cast("bigint").alias("ord"), "element")
