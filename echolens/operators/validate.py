"""Row rules: accepted rows and quarantined rows.

A bad row never stops a job. Each rule yields a code ``field: problem`` when broken; rows with codes go to
quarantine with the codes in ``errors``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schemas as S

# Formats of the reference's schemas.
URL_PATTERN = r"^(?i:(?:https?|ftp|wss?)://[^\s/?#]+\S*|(?!(?:https?|ftp|wss?):)[a-z][a-z0-9+.\-]*:\S*)$"
UUID_PATTERN = "^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
ISO_UTC_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?Z$"
RESULT_TYPES = ("scraped_reviews", "labeled_reviews", "exported_data")
OUTPUT_FORMATS = ("csv", "json", "database")
CLEANUP_TARGETS = ("old_reviews", "failed_jobs", "temp_files")
EXPORT_FORMATS = ("csv", "json", "xlsx")

Rule = tuple[str, Column]
_BETWEEN_CODES = "\n"


def _checked(df: DataFrame, codes: Column, *others: Column) -> DataFrame:
    """Add the codes as text in ``_errors``.

    The generator keeps the filters below from being merged into the projection, which would evaluate every rule
    twice per row.
    """
    return df.select("*", F.inline(F.array(F.struct(codes.alias("_errors"), *others))))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``errors``). A rule that evaluates to NULL is not broken."""
    codes = F.concat_ws(_BETWEEN_CODES, *[F.when(broken, F.lit(code)) for code, broken in rules])
    return _split_checked(_checked(df, codes))


def _split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = checked.where(F.col("_errors") != "").withColumn("errors", F.split("_errors", _BETWEEN_CODES))
    return checked.where(F.col("_errors") == "").drop("_errors"), bad.drop("_errors")


# --- reviews and stored rows ---------------------------------------------------------------------------------


def review_rules(require_url: bool = False) -> list[Rule]:
    c = F.col
    rules = [(f"{name}: required", c(name).isNull()) for name in ("id", "user_name", "version", "title", "text", "date")]
    rules += [
        ("score: range", c("score").isNull() | ~c("score").between(1, 5)),
        ("url: format", ~c("url").rlike(URL_PATTERN)),
        ("user_url: format", ~c("user_url").rlike(URL_PATTERN)),
        ("helpful_votes: range", c("helpful_votes") < 0),
        ("country: length", c("country").isNull() | (F.length("country") != 2)),
    ]
    if require_url:
        rules.append(("url: required", c("url").isNull()))
    return rules


def validate_reviews(reviews: DataFrame, require_url: bool = False) -> tuple[DataFrame, DataFrame]:
    filled = reviews.withColumns(
        {"helpful_votes": F.coalesce("helpful_votes", F.lit(0)), "country": F.upper("country")}
    )
    return split(filled, review_rules(require_url))


STORED_RULES: dict[str, Callable[[], list[Rule]]] = {
    "apps": lambda: [("id: required", F.col("id").isNull()), ("title: required", F.col("title").isNull())],
    "reviews": lambda: [
        ("id: required", F.col("id").isNull()),
        ("app_id: required", F.col("app_id").isNull()),
        ("country: required", F.col("country").isNull()),
        ("score: range", ~F.col("score").between(1, 5)),
    ],
    "labels": lambda: [
        ("id: required", F.col("id").isNull()),
        ("review_id: required", F.col("review_id").isNull()),
        ("sentiment: required", F.col("sentiment").isNull()),
        ("confidence: range", F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)),
    ],
}


def check_stored(rows: DataFrame, table: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Stored-row constraints including uniqueness of the key.

    Duplicate keys come from a count per key that is combined before the shuffle; only the repeated keys are
    joined back, so a unique table meets an empty side.
    """
    repeated = rows.groupBy(key).agg(F.count("*").alias("_copies")).where("_copies > 1")
    flagged = rows.join(repeated, key, "left")
    rules = STORED_RULES[table]() + [(f"{key}: duplicate", F.col("_copies") > 1)]
    ok, bad = split(flagged, rules)
    return ok.select(*rows.columns), bad.select(*rows.columns, "errors")


# --- job payloads --------------------------------------------------------------------------------------------
#
# The rules of a payload are SQL text over one column per member, its value (v_). In a rule ``@`` is the member's
# name, ``k_@`` its JSON kind, ``t_@`` its text and ``n_@`` its number; these are only worked out in the CASE branches
# that need them.


class Field(NamedTuple):
    """One payload member: its JSON kind, the default as SQL, whether it is required, and its rules.

    A rule is (problem, SQL condition that holds when it is broken).
    """

    name: str
    kind: str
    default: str | None = None
    required: bool = False
    rules: tuple[tuple[str, str], ...] = ()


_KINDS = {
    "string": "k_@ = 'STRING'",
    "boolean": "k_@ = 'BOOLEAN'",
    "number": "k_@ RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'",
    "array": "k_@ LIKE 'ARRAY<%'",
    "object": "k_@ LIKE 'OBJECT<%'",
}
_NOT_EMPTY = (("empty", "t_@ = ''"),)


def _list(names: Sequence[str]) -> str:
    return ", ".join(f"'{name}'" for name in names)


def _whole(low: int, high: int | None = None) -> tuple[tuple[str, str], ...]:
    outside = f"n_@ < {low}" if high is None else f"n_@ NOT BETWEEN {low} AND {high}"
    return ("integer", "n_@ % 1 <> 0"), ("range", outside)


def _one_of(names: Sequence[str]) -> tuple[tuple[str, str], ...]:
    return (("enum", f"t_@ NOT IN ({_list(names)})"),)


def _text_items(broken: str) -> tuple[tuple[str, str], ...]:
    """Rules of a list of texts; ``broken`` is a condition on the item text ``t``."""
    items = "try_variant_get(v_@, '$', 'array<variant>')"
    bad = f"schema_of_variant(e) <> 'STRING' OR {broken.replace('{t}', 'cast(e AS string)')}"
    return ("empty", f"size({items}) = 0"), ("item", f"exists({items}, e -> {bad})")


def _bad_time(member: str) -> tuple[str, str]:
    text = f"try_variant_get(v_@, '$.{member}', 'string')"
    return member, f"coalesce(NOT {text} RLIKE '{ISO_UTC_PATTERN}' OR try_to_timestamp({text}) IS NULL, true)"


COMMON_FIELDS = (
    Field("correlationId", "string", rules=(("uuid", f"NOT t_@ RLIKE '{UUID_PATTERN}'"),)),
    Field("priority", "number", str(S.DEFAULT_PRIORITY), rules=_whole(1, 10)),
    Field("retryAttempts", "number", str(S.DEFAULT_ATTEMPTS), rules=_whole(0, 5)),
    Field("delay", "number", str(S.DEFAULT_DELAY), rules=_whole(0)),
)
JOB_FIELDS: dict[str, tuple[Field, ...]] = {
    "scrape_reviews": (
        Field("appId", "string", required=True, rules=_NOT_EMPTY),
        Field("countries", "array", f"array({_list(S.DEFAULT_COUNTRIES)})", rules=_text_items("length({t}) <> 2")),
        Field("pages", "number", str(S.DEFAULT_PAGES), rules=_whole(1, S.MAX_PAGES)),
        Field("sortMethods", "array", "array('recent')", rules=_text_items(f"{{t}} NOT IN ({_list(S.SORT_METHODS)})")),
        Field("throttleMs", "number", str(S.DEFAULT_THROTTLE_MS), rules=_whole(0, 5000)),
    ),
    "label_reviews": (
        Field("reviewIds", "array", required=True, rules=_text_items("{t} = ''")),
        Field("batchSize", "number", str(S.DEFAULT_BATCH_SIZE), rules=_whole(1, 100)),
        Field("model", "string", f"'{S.DEFAULT_PAYLOAD_MODEL}'"),
        Field("taxonomyPath", "string"),
    ),
    "process_results": (
        Field("sourceJobId", "string", required=True, rules=_NOT_EMPTY),
        Field("resultType", "string", required=True, rules=_one_of(RESULT_TYPES)),
        Field("outputFormat", "string", "'database'", rules=_one_of(OUTPUT_FORMATS)),
    ),
    "cleanup_data": (
        Field("targetType", "string", required=True, rules=_one_of(CLEANUP_TARGETS)),
        Field("olderThanDays", "number", "30", rules=_whole(1)),
        Field("dryRun", "boolean", "false"),
    ),
    "export_data": (
        Field("appId", "string", required=True, rules=_NOT_EMPTY),
        Field("format", "string", "'csv'", rules=_one_of(EXPORT_FORMATS)),
        Field("includeLabels", "boolean", "true"),
        Field("dateRange", "object", rules=(_bad_time("startDate"), _bad_time("endDate"))),
    ),
}
RESULT_FIELDS = (
    Field("success", "boolean", required=True),
    Field("message", "string"),
    Field("data", "object"),
    Field("error", "string"),
    Field("processingTime", "number", rules=_whole(0)),
    Field("itemsProcessed", "number", rules=_whole(0)),
)


def _with_members(df: DataFrame, json_col: str, fields: Sequence[Field]) -> DataFrame:
    """The members as columns ``v_<name>``: one parse and one cast of the object to all of its known members."""
    names = sorted({field.name for field in fields})
    kind = ", ".join(f"`{name}`: variant" for name in names)
    parsed = df.withColumn("_json", F.try_parse_json(json_col))
    known = parsed.withColumn("_members", F.expr(f"try_variant_get(_json, '$', 'struct<{kind}>')"))
    return known.withColumns({f"v_{name}": F.col(f"_members.`{name}`") for name in names}).drop("_members")


_PARTS = {
    "k_@": "schema_of_variant(v_@)",
    "t_@": "try_variant_get(v_@, '$', 'string')",
    "n_@": "try_variant_get(v_@, '$', 'double')",
}


def _spelled_out(text: str, name: str) -> str:
    for short, full in _PARTS.items():
        text = text.replace(short, full)
    return text.replace("@", name)


def _codes(fields: Sequence[Field]) -> str:
    """SQL text for the codes of the fields: the first broken rule of each."""

    def code(field: Field) -> str:
        missing = "'@: required'" if field.required else "NULL"
        rules = [("type", f"NOT ({_KINDS[field.kind]})"), *field.rules]
        cases = " ".join(f"WHEN {broken} THEN '@: {problem}'" for problem, broken in rules)
        return _spelled_out(f"CASE WHEN v_@ IS NULL THEN {missing} {cases} END", field.name)

    return f"concat_ws('{_BETWEEN_CODES}', {', '.join(code(field) for field in fields)})"


_OBJECT_TYPES = {"dateRange": "struct<startDate string, endDate string>"}
_SQL_VALUES = {
    "string": "t_@",
    "number": "try_cast(n_@ AS bigint)",
    "boolean": "try_variant_get(v_@, '$', 'boolean')",
    "array": "try_variant_get(v_@, '$', 'array<string>')",
}


def _filled(fields: Sequence[Field]) -> str:
    """SQL text for the payload with defaults in place and unknown members dropped."""

    def value(field: Field) -> str:
        if field.kind == "object":
            return f"try_variant_get(v_{field.name}, '$', '{_OBJECT_TYPES[field.name]}')"
        found = _spelled_out(_SQL_VALUES[field.kind], field.name)
        return found if field.default is None else f"coalesce({found}, {field.default})"

    members = ", ".join(f"'{field.name}', {value(field)}" for field in fields)
    return f"to_json(named_struct({members}))"


def _by_type(text_for: Callable[[tuple[Field, ...]], str], otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN '{name}' THEN {text_for(fields + COMMON_FIELDS)}" for name, fields in JOB_FIELDS.items())
    return f"CASE type {cases} ELSE {otherwise} END"


def validate_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) jobs from ``type`` and the JSON text ``payload``.

    Defaults are filled into accepted payloads; quarantined payloads stay as they came.
    """
    every_field = [field for fields in (*JOB_FIELDS.values(), COMMON_FIELDS) for field in fields]
    known = f"coalesce(type IN ({_list(S.JOB_TYPES)}), false)"
    codes = (
        f"CASE WHEN NOT {known} THEN 'type: unknown' "
        "WHEN NOT coalesce(schema_of_variant(_json) LIKE 'OBJECT<%', false) THEN 'payload: type' "
        f"ELSE {_by_type(_codes)} END"
    )
    checked = _checked(_with_members(jobs, "payload", every_field), F.expr(codes))
    ok, bad = _split_checked(checked)
    ok = ok.withColumn("payload", F.expr(_by_type(_filled)))
    return ok.select(*jobs.columns), bad.select(*jobs.columns, "errors")


def validate_job_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) job results held as JSON text in ``result``."""
    is_object = "coalesce(schema_of_variant(_json) LIKE 'OBJECT<%', false)"
    codes = F.expr(f"CASE WHEN {is_object} THEN {_codes(RESULT_FIELDS)} ELSE 'result: type' END")
    ok, bad = _split_checked(_checked(_with_members(results, "result", RESULT_FIELDS), codes))
    return ok.select(*results.columns), bad.select(*results.columns, "errors")
