"""Labeling: requests, responses, fallback, and the model call inside executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.coercion import is_kind, with_exact_json
from echolens.operators.normalize import breaks_batch, clean_labels, restrict_to_taxonomy

# A labeler gets the system prompt and the (id, text) pairs of one batch, and returns the response text or raises.
Labeler = Callable[[str, list[tuple[str, str]]], str]


def system_prompt(taxonomy: dict | list) -> str:
    themes = json.dumps(taxonomy, indent=2, ensure_ascii=False)
    return (
        "You label customer reviews of an app.\n\n"
        f"Choose themes from this taxonomy:\n{themes}\n\n"
        f'Give each review one theme ("{S.FALLBACK_THEME}" when none fits), a sentiment (positive, neutral or '
        "negative), a severity from 1 to 5 (1 unless negative), whether it asks for a feature, a quote of at most "
        "20 words, and your confidence from 0 to 1.\n\n"
        "Answer with a JSON array only, one object per review, with the members reviewId, theme, sentiment, "
        "severity, featureRequest, directQuote and confidence."
    )


# So many ids of answers may be sent to all tasks.
ANSWER_ROWS = 100_000
# A task passes its answers on when it has so many, or so many characters of them.
ANSWERS, ANSWER_CHARS = 1_000, 1 << 20

# Layout of the user prompt, and how it shows a value that is not there.
ABSENT = "null"
PROMPT_HEAD = "Analyze these app reviews:\n\n"
PROMPT_ITEM = '{n}. ID: {id}\nText: "{text}"\n---'


def user_prompt(reviews: Sequence[tuple[str, str]]) -> str:
    shown = [(ABSENT if i is None else i, ABSENT if t is None else t) for i, t in reviews]
    return PROMPT_HEAD + "\n".join(PROMPT_ITEM.format(n=n, id=i, text=t) for n, (i, t) in enumerate(shown, 1))


def label_requests(batches: DataFrame, taxonomy: dict | list, by: Sequence[str] = ()) -> DataFrame:
    """One request row per batch. ``batches`` has batch_no, position, id and text; a batch is at most 100 rows."""
    members = F.array_sort(F.collect_list(F.struct("position", "id", "text")))
    items = F.transform(
        F.col("_members"),
        lambda m: F.concat(
            m["position"].cast("string"), F.lit(". ID: "), F.coalesce(m["id"], F.lit(ABSENT)), F.lit('\nText: "'),
            F.coalesce(m["text"], F.lit(ABSENT)), F.lit('"\n---'),
        ),
    )
    return (
        batches.groupBy(*by, "batch_no")
        .agg(members.alias("_members"))
        .select(
            *by,
            "batch_no",
            F.col("_members.id").alias("review_ids"),
            F.lit(system_prompt(taxonomy)).alias("system_prompt"),
            F.concat(F.lit(PROMPT_HEAD), F.array_join(items, "\n")).alias("user_prompt"),
        )
    )


def _with_elements(responses: DataFrame) -> DataFrame:
    """Add ``_elements``: the result array of each response, NULL when the batch has failed."""
    listed = F.when(is_kind(F.col("_json"), "array"), F.try_variant_get("_json", "$", "array<variant>")).when(
        is_kind(F.try_variant_get("_json", "$.results", "variant"), "array"),
        F.try_variant_get("_json", "$.results", "array<variant>"),
    )
    usable = F.when(~F.exists("_listed", breaks_batch), F.col("_listed"))
    read = with_exact_json(responses, "content", "_json").withColumn("_listed", listed)
    return read.withColumn("_elements", usable).drop("_json", "_listed")


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements with one ``element`` variant per row, responses that failed). ``content`` is the response text."""
    read = _with_elements(responses)
    others = [name for name in responses.columns if name != "content"]
    # Over the plain column Spark would infer a filter and evaluate the parsing a second time in it.
    present = F.coalesce("_elements", F.array().cast("array<variant>"))
    elements = read.select(*others, F.explode(present).alias("element"))
    failed = read.where(F.col("_elements").isNull()).drop("_elements")
    return elements, failed


def _fallback_columns(review_id: Column, model: str) -> list[Column]:
    return [
        review_id.alias("review_id"),
        F.lit(S.FALLBACK_THEME).alias("theme"),
        F.lit("neutral").alias("sentiment"),
        F.lit(1).alias("severity"),
        F.lit(False).alias("feature_request"),
        F.lit("").alias("direct_quote"),
        F.lit(0).cast(S.CONFIDENCE).alias("confidence"),
        F.lit(model).alias("model_version"),
    ]


def fallback_labels(failed: DataFrame, members: DataFrame, model: str, on: Sequence[str] = ("batch_no",)) -> DataFrame:
    """A neutral label with confidence 0 for each review of a failed batch."""
    hit = members.join(failed.select(*on), list(on), "left_semi")
    return hit.select(*on, *_fallback_columns(F.col("id"), model))


def theme_names(taxonomy: dict | list) -> list[str]:
    """Names of the themes of a taxonomy, which holds names or objects with a name."""
    themes = taxonomy.get("themes", []) if isinstance(taxonomy, dict) else taxonomy
    return [theme["name"] if isinstance(theme, dict) else theme for theme in themes]


def labels_from_responses(responses: DataFrame, model: str = S.DEFAULT_LABEL_MODEL) -> DataFrame:
    """Labels of all batches in one pass: cleaned elements, or the fallback for a failed batch.

    ``responses`` has ``review_ids`` and ``content``. One pass matters when ``responses`` makes the model calls:
    a second read of it would make them again. ``answer_ord`` orders the labels of a batch as answered.
    """
    answered = F.transform("_elements", lambda e: F.struct(e.alias("element"), F.lit(None).cast("string").alias("id")))
    unanswered = F.transform("review_ids", lambda i: F.struct(F.lit(None).cast("variant").alias("element"), i.alias("id")))
    items = F.when(F.col("_elements").isNotNull(), answered).otherwise(unanswered)
    exploded = _with_elements(responses).select("review_ids", F.posexplode(items).alias("_pos", "_item")).select(
        F.struct(F.get("review_ids", 0).alias("batch"), F.col("_pos").alias("pos")).alias("answer_ord"), "_item.*"
    )
    cleaned = clean_labels(exploded, model)
    fallback = _fallback_columns(F.col("id"), model)
    names = [name for name in cleaned.columns if name not in ("answer_ord", "id")]
    chosen = [
        F.when(F.col("id").isNotNull(), default).otherwise(F.col(name)).alias(name)
        for name, default in zip(names, fallback, strict=True)
    ]
    return cleaned.select(*chosen, "answer_ord")


RESPONSE_SCHEMA = "review_ids array<string>, content string, error string"


def call_labeler(
    reviews: DataFrame, taxonomy: dict | list, labeler: Labeler, batch_size: int, concurrency: int | None = None
) -> DataFrame:
    """Response table of the model, called in the executors once per batch.

    Batches form inside each partition, so the number of partitions bounds the number of calls at a time.
    ``concurrency`` sets it, at the price of a shuffle that is small beside the calls; without it the input keeps
    its partitions. A call that raises leaves its batch with NULL content and the message in ``error``. A task holds the
    texts of one batch and answers of about a megabyte, however many reviews it has.
    """
    prompt = system_prompt(taxonomy)

    def answer(batch: list[tuple[str, str]]) -> tuple:
        ids = [review_id for review_id, _ in batch]
        try:
            return ids, labeler(prompt, batch), None
        except Exception as problem:  # a failed call only costs its own batch
            return ids, None, str(problem)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [("review_ids", pa.list_(pa.string())), ("content", pa.string()), ("error", pa.string())]
        made: list[tuple] = []
        rest: list[tuple[str, str]] = []
        size = 0

        def written() -> pa.RecordBatch:
            columns = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, batch_size - len(rest))
                at += part.num_rows
                rest += zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)
                if len(rest) == batch_size:
                    made.append(answer(rest))
                    size, rest = size + len(made[-1][1] or ""), []
                if len(made) >= ANSWERS or size >= ANSWER_CHARS:
                    yield written()
                    made, size = [], 0
        if rest:
            made.append(answer(rest))
        if made:
            yield written()

    texts = reviews.select("id", "text")
    if concurrency is not None:
        texts = texts.repartition(concurrency, "id")  # by key, so that a recomputed partition holds the same rows
    return texts.mapInArrow(run, RESPONSE_SCHEMA)


def label_reviews(
    reviews: DataFrame,
    taxonomy: dict | list,
    labeler: Labeler,
    batch_size: int = S.DEFAULT_BATCH_SIZE,
    model: str = S.DEFAULT_LABEL_MODEL,
    concurrency: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Labels for all reviews, with the fallback where a call or a response failed.

    ``strict`` turns a theme that the taxonomy does not have into general feedback; otherwise it stays as answered.
    """
    labels = labels_from_responses(call_labeler(reviews, taxonomy, labeler, batch_size, concurrency), model)
    return restrict_to_taxonomy(labels, theme_names(taxonomy)) if strict else labels


def split_unmatched(
    labels: DataFrame, reviews: DataFrame, label_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(labels whose review exists, the others). Models may answer for reviews nobody asked about.

    ``label_rows`` is the number of labels when it is known. When they are few, the reviews are reduced to the ids
    answered for first, by a broadcast semi join outward, so the review table is neither shuffled nor sorted.
    """
    known = reviews.select(F.col("id").alias("review_id"))
    if label_rows is not None and label_rows <= ANSWER_ROWS:
        known = F.broadcast(known.join(F.broadcast(labels.select("review_id").distinct()), "review_id", "left_semi"))
    return labels.join(known, "review_id", "left_semi"), labels.join(known, "review_id", "left_anti")
