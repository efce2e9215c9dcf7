"""Line-first cleaning: rules per line, then a verdict on documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import BLANK, WORD

# The white space of the contract, closing punctuation, separators of menus, phrases of page furniture.
_WHITE = " \t\n\x0b\x0c\r"
_CLOSING = ".!?…:;\"'”’»)]。！？"
_SEPARATORS = r"[|»›•·]|\s[>/]\s"
_FURNITURE = (
    "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "click here", "sign in",
    "log in", "subscribe", "newsletter", "javascript", "skip to content", "read more", "share this", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutz", "tous droits réservés", "mentions légales", "todos los derechos reservados",
)
_SYMBOLS = "[#*$%&|<>]"
# A position in a text takes 28 bits, the rest is hash; equal hashes are only candidates and are compared as text.
_POSITION_BITS = 28


def _word_chars(text: Column) -> Column:
    """Characters that are no blanks."""
    for blank in _WHITE:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.length(text).cast("long")


def _repeat_positions(windows: Column) -> Column:
    """Positions of the windows of a sorted array of (text, position) whose text occurs twice or more."""
    return F.sort_array(
        F.transform(
            F.filter(
                windows,
                lambda x, j: (x["t"] == F.get(windows, j + 1)["t"])
                | ((j > 0) & (x["t"] == F.get(windows, F.greatest(j - 1, F.lit(0)))["t"])),
            ),
            lambda x: x["p"],
        )
    )


def _judged(docs: DataFrame, text_col: str, furniture_chars: int, min_kept: float) -> DataFrame:
    """``given``, the columns of ``docs`` as one struct, so that their names cannot meet others, and ``quality``."""
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")
    step = docs.select(given, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    step = step.withColumn("trimmed", F.btrim("t", F.lit(_WHITE)))
    step = step.withColumn(
        "w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", BLANK))
    ).withColumn(
        "all", F.transform(F.split("t", "\n"), lambda x: F.struct(x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    )
    words, n = F.col("w"), F.size("w")
    # Hashes of neighbouring words in turn, so that the borders of the words count.
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))
    )
    step = step.withColumn("h", windows)

    def packed(h: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftright(h, _POSITION_BITS), _POSITION_BITS).bitwiseOR(i.cast("long"))

    # Most texts repeat no window; only the others are looked at closely.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    nothing = F.array().cast("array<bigint>")
    step = step.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", packed))).otherwise(nothing))
    sorted_windows = F.col("s")

    def hashed(x: Column) -> Column:
        return F.shiftright(x, _POSITION_BITS)

    candidates = F.filter(
        sorted_windows,
        lambda x, j: (hashed(x) == hashed(F.get(sorted_windows, j + 1)))
        | ((j > 0) & (hashed(x) == hashed(F.get(sorted_windows, F.greatest(j - 1, F.lit(0)))))),
    )

    def spelled(x: Column) -> Column:
        p = x.bitwiseAND((1 << _POSITION_BITS) - 1).cast("int")
        text = F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
        return F.struct(text.alias("t"), p.alias("p"))

    step = step.withColumn("c", F.sort_array(F.transform(candidates, spelled)))
    step = step.withColumn("p", _repeat_positions(F.col("c")))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3))).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )

    def stays(line: Column, n: Column) -> Column:
        separators = F.regexp_count(line, F.lit(_SEPARATORS))
        phrase = F.lower(line).rlike("|".join(_FURNITURE))
        return (
            F.right(F.rtrim(line, F.lit(_WHITE)), F.lit(1)).isin(*_CLOSING)
            & (3 * F.regexp_count(line, F.lit("[!?]")) <= n)
            & (2 * F.regexp_count(line, F.lit(_SYMBOLS)) <= n)
            & ~((separators >= 2) | ((separators == 1) & (n <= 3)))
            & ~((F.length(line) <= furniture_chars) & phrase)
        )

    step = step.withColumn("stay", F.filter("all", lambda x: (x["n"] == 0) | stays(x["x"], x["n"])))
    step = step.withColumn("spoken", F.transform(F.filter("all", lambda x: x["n"] > 0), lambda x: x["x"]))
    step = step.withColumn("cleaned", F.array_join(F.col("stay.x"), "\n"))
    n_words = n.cast("long")
    base_failed = (n_words < 50) | (100 * F.col("repeat") > 50 * n_words)
    step = step.withColumn("repeat", covered).withColumn("chars", _word_chars(F.col("t")))
    quality = F.struct(
        n_words.alias("n_words"), F.col("chars").alias("word_chars"),
        F.regexp_count("t", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (_word_chars(F.col("cleaned")) >= min_kept * F.col("chars"))).alias("kept"),
        F.size("spoken").cast("long").alias("lines"),
        (F.size("all") - F.size("stay")).cast("long").alias("lines_removed"),
        F.col("cleaned").alias("cleaned"),
    )
    # Behind a generator, a filter on the result is not moved into the steps above, where each element of an array
    # would compute that array again.
    return step.select("given", F.explode(F.array(quality)).alias("quality"))


def with_line_rules(
    docs: DataFrame, text_col: str = "text", furniture_chars: int = 200, min_kept: float = 0.5
) -> DataFrame:
    """``docs`` with a struct ``__quality``; a column of that name is replaced.

    It holds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines, lines_removed,
    cleaned``. A line with a word is removed when it

    * does not end in closing punctuation, has more exclamation and question marks than a third of its words, or more
      symbols of ``#*$%&|<>`` than half of its words (punctuation),
    * has two or more menu separators, or one and at most three words (navigation),
    * is at most ``furniture_chars`` long and holds a phrase of page furniture (boilerplate).

    A document is kept when the base rules pass and the remaining lines hold at least ``min_kept`` of the characters.
    Null and empty texts have no words and fail; lines without a word stay and count for nothing; rows that repeat are
    judged alike; an empty table gives no rows. Everything is a built-in expression over one row; only arrays of one
    document are in memory, and nothing is shuffled. A text may have up to 268 million words.
    """
    judged = _judged(docs, text_col, furniture_chars, min_kept)
    kept = [F.col(f"given.`{c}`") for c in docs.columns if c != "__quality"]
    return judged.select(*kept, F.col("quality").alias("__quality"))


def clean_lines(
    docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", furniture_chars: int = 200, min_kept: float = 0.5
) -> DataFrame:
    """The kept documents with failing lines removed and their length in characters, other columns as they are.

    The rules and the cases are those of ``with_line_rules``.
    """
    judged = _judged(docs, text_col, furniture_chars, min_kept).where("quality.kept")
    changes = {text_col: F.col("quality.cleaned")}
    if chars_col in docs.columns:
        changes[chars_col] = F.length("quality.cleaned").cast(docs.schema[chars_col].dataType)
    return judged.select(*[changes.get(c, F.col(f"given.`{c}`")).alias(c) for c in docs.columns])
