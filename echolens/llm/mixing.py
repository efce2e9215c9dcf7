"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and ``cap`` whose tokens meet each source's target, the mix takes the ones with the
least relative entropy to 1, where a document of ``size`` tokens counts ``size ** (1 - tilt)``. The solution is an
exponential tilt, ``rate = min(cap, exp(lambda_source * size ** tilt))``. The multipliers solve a convex dual, one
smooth monotone equation per source, by safeguarded Newton steps; each step is one aggregation of the (source, size)
counts. ``tilt`` 1 is plain per-document entropy, 0 gives all documents of a source the same rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import ROW_KEY, gapless, n_words, stored, with_row_key

_TOLERANCE = 1e-9
_MAX_STEPS = 80
_REPAIRS = 4


def source_targets(sizes: DataFrame, weights: int = 3, cap: int = 3) -> DataFrame:
    """Targets of the sources of ``sizes(_src, source, source_size)``, one row each.

    Sources in code point order, null last, weigh 1, 2, .. ``weights``, repeating, and share the sum of all sizes.
    A target stops at ``cap`` times its source's size; the excess is shared again by weight until none is above. That
    fixed point is ``min(cap * size, level * weight)`` with one level for all, found by ordering the sources by the
    level at which they reach their cap. There is one row per source, so these windows stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("_weight", ((F.row_number().over(order) - 1) % weights + 1).cast("double")).withColumn(
        "_limit", F.col("source_size").cast("double") * cap
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("_limit") / F.col("_weight"), "_src").rowsBetween(Window.unboundedPreceding, -1)
    below = weighted.select(
        "*",
        F.sum("source_size").over(whole).cast("double").alias("_all"),
        F.sum("_weight").over(whole).alias("_weights"),
        F.coalesce(F.sum("_limit").over(by_level), F.lit(0.0)).alias("_capped"),
        F.coalesce(F.sum("_weight").over(by_level), F.lit(0.0)).alias("_capped_weights"),
    )
    # The level if exactly the sources before this one are at their cap; the first for which this one is not holds.
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_capped_weights"))
    found = below.withColumn("_level", F.when(level * F.col("_weight") <= F.col("_limit"), level))
    final = F.max("_level").over(whole)
    target = F.least(F.col("_limit"), F.coalesce(final, F.lit(float("inf"))) * F.col("_weight"))
    return found.select("_src", "source", "source_size", target.alias("target"))


def solve_multipliers(cells: DataFrame, sources: DataFrame, tilt: float, cap: int) -> DataFrame:
    """``sources`` with ``_lambda``, the root of each source's dual gradient, by distributed Newton steps.

    ``cells`` holds (``_src``, ``size``, ``_n``). A step aggregates gradient and curvature per source, combined in each
    task before the shuffle. A root stays bracketed, and a step that leaves the bracket is replaced by its middle, so
    the iteration converges from anywhere. Each round is stored; only the number of open sources reaches the driver.
    """
    x = F.pow(F.col("size") / F.col("_scale"), F.lit(tilt))
    scales = cells.where("size > 0").groupBy("_src").agg(
        (F.sum(F.col("size") * F.col("_n")) / F.sum("_n")).alias("_scale"), F.min("size").alias("_least")
    )
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    least = F.pow(F.col("_least") / F.col("_scale"), F.lit(tilt))
    full = ratio >= cap * (1 - _TOLERANCE)
    state = stored(
        sources.join(scales, "_src", "left").select(
            "*",
            F.when(ratio < 1, F.log(ratio) / least).otherwise(0.0).alias("_low"),
            F.when(ratio > 1, F.log(F.lit(float(cap))) / least).otherwise(0.0).alias("_high"),
            # Where all documents are at the cap there is nothing to solve, nor where there are no tokens.
            F.when(F.col("source_size") == 0, 0.0)
            .when(full, F.log(F.lit(float(cap))) / least)
            .otherwise(F.log(ratio))
            .alias("_lambda"),
            (full | (F.col("source_size") == 0)).alias("_done"),
        ),
        "multipliers",
    )
    for _ in range(_MAX_STEPS):
        if state.where(~F.col("_done")).isEmpty():
            return state
        tokens = F.col("size") * F.col("_n") * F.least(F.exp(F.col("_lambda") * x), F.lit(float(cap)))
        inside = F.exp(F.col("_lambda") * x) < cap
        sums = (
            cells.where("size > 0")
            .join(state.where(~F.col("_done")).select("_src", "_scale", "_lambda"), "_src")
            .groupBy("_src")
            .agg(F.sum(tokens).alias("_tokens"), F.sum(F.when(inside, tokens * x).otherwise(0.0)).alias("_slope"))
        )
        gradient = F.col("_tokens") - F.col("target")
        moved = F.col("_lambda") - gradient / F.col("_slope")
        low = F.when(gradient < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(gradient > 0, F.col("_lambda")).otherwise(F.col("_high"))
        near = F.abs(gradient) <= F.col("target") * _TOLERANCE
        stepped = state.join(sums, "_src", "left").select(
            *sources.columns, "_scale", "_least",
            F.when(F.col("_done"), F.col("_low")).otherwise(low).alias("_low"),
            F.when(F.col("_done"), F.col("_high")).otherwise(high).alias("_high"),
            F.when(F.col("_done") | near, F.col("_lambda"))
            .when((F.col("_slope") > 0) & (moved > low) & (moved < high), moved)
            .otherwise((low + high) / 2)
            .alias("_lambda"),
            (F.col("_done") | near | (high - low <= F.abs(low) * 1e-15)).alias("_done"),
        )
        state = stored(stepped, "multipliers")
    if not state.where(~F.col("_done")).isEmpty():
        raise RuntimeError(f"no multiplier of every source meets its target after {_MAX_STEPS} steps")
    return state


def _round_copies(cells: DataFrame, cap: int) -> DataFrame:
    """Whole copies per cell: cumulative rounding from long to short documents, then repairs of each source's rest.

    Rounding the running sum keeps the copies of every run of sizes within one of their expectation. What is left of
    a source's target is then made up, a few times, with the longest documents that still fit.
    """
    upto = Window.partitionBy("_src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("_n") * cap
    running = cells.withColumn("_sum", F.round(F.sum(F.least(F.col("_rate"), F.lit(float(cap))) * F.col("_n")).over(upto)))
    last = F.lag("_sum", 1, 0.0).over(Window.partitionBy("_src").orderBy(F.desc("size")))
    copies = stored(
        running.withColumn("_copies", F.greatest(F.lit(0), F.least((F.col("_sum") - last).cast("long"), room))), "copies"
    )
    for _ in range(_REPAIRS):
        rest = copies.groupBy("_src").agg(
            F.round(F.first("target") - F.sum(F.col("_copies") * F.col("size"))).cast("long").alias("_rest")
        )
        joined = copies.join(rest, "_src").withColumn(
            "_fits",
            F.when(F.col("size") == 0, 0)
            .when(F.col("_rest") > 0, F.least(F.floor(F.col("_rest") / F.col("size")), room - F.col("_copies")))
            .otherwise(F.least(F.floor(-F.col("_rest") / F.col("size")), F.col("_copies"))),
        )
        best = joined.where("_fits > 0").groupBy("_src").agg(F.max("size").alias("_best"))
        signed = F.when(F.col("size") == F.col("_best"), F.signum("_rest").cast("long") * F.col("_fits")).otherwise(0)
        copies = stored(
            joined.join(best, "_src", "left").select(
                *[c for c in copies.columns if c != "_copies"],
                (F.col("_copies") + F.coalesce(signed, F.lit(0))).cast("long").alias("_copies"),
            ),
            "copies",
        )
    return copies


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: int = 3,
    cap: int = 3,
    tilt: float = 0.5,
    size: Column | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, rate, copies, taken`` and the row key.

    ``size`` is the number of words (null text: 0) unless given. A null source is a source of its own. Copies are
    between 0 and ``cap`` and each source's ``taken`` words meet its target but for less than the shortest document
    that could make up the rest, as a rule. Which documents of one source and size get one copy more follows from a
    hash of id and row, so reruns agree. Documents without words have size 0 and rate 1, and take nothing. An empty
    table gives no rows.
    """
    src = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = stored(
        with_row_key(docs).select(
            F.col(id_col).alias("_id"), *ROW_KEY, src.alias("_src"), F.col(source_col).cast("string").alias("source"),
            (n_words(F.col(text_col)) if size is None else size.cast("long")).alias("size"),
            F.xxhash64(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("_hash"),
        ),
        "sizes",
    )
    cells = stored(rows.groupBy("_src", "source", "size").agg(F.count("*").alias("_n")), "cells")
    sizes = cells.groupBy("_src", "source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    sources = stored(source_targets(sizes, weights, cap), "targets")
    solved = solve_multipliers(cells, sources, tilt, cap)
    x = F.pow(F.col("size") / F.col("_scale"), F.lit(tilt))
    rate = F.when(F.col("_lambda").isNull() | F.col("_scale").isNull() | (F.col("size") == 0), 1.0).otherwise(
        F.least(F.exp(F.col("_lambda") * x), F.lit(float(cap)))
    )
    rated = cells.join(solved.drop("source"), "_src").select(
        "_src", "size", "_n", "source_size", "target", rate.alias("_rate")
    )
    copies = _round_copies(rated, cap)
    ranked = gapless(rows, ["_src", "size"], ["_hash", "_id", *ROW_KEY], "_rank", F.col("_hash"))
    each = F.floor(F.col("_copies") / F.col("_n"))
    more = F.when(F.col("_rank") < F.col("_copies") - each * F.col("_n"), 1).otherwise(0)
    own = F.when(F.col("size") == 0, 1).otherwise(each + more).cast("long")
    return ranked.join(copies, ["_src", "size"]).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", F.col("_rate").alias("rate"),
        own.alias("copies"), (own * F.col("size")).alias("taken"), *ROW_KEY,
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as ``mix`` decides; rows with no copy go.

    The given columns travel as one, so that their names meet no others. Cases are those of ``mix``.
    """
    keyed = with_row_key(docs)
    copies = mix(keyed, **options).select(*ROW_KEY, "copies")
    given = keyed.select(*ROW_KEY, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))
    return (
        given.join(copies, list(ROW_KEY))
        .select("given", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select(*[F.col(f"given.`{c}`") for c in docs.columns])
    )
