"""Loose-typing rules of the reference as Column expressions.

The reference treats null, '', 0, NaN and false alike as "no value" and reads numbers from the start of a
string. Those rules decide stored values, so they are kept; here they are plain built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions.text import WHITE_SPACE

INTEGER_PREFIX = rf"(?U)^{WHITE_SPACE}*([+-]?[0-9]+)"
HEX_PREFIX = rf"(?U)^{WHITE_SPACE}*[+-]?0[xX]([0-9a-fA-F]+)"
FLOAT_PREFIX = rf"(?U)^{WHITE_SPACE}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INFINITY_PREFIX = rf"(?U)^{WHITE_SPACE}*([+-]?)Infinity"


def text_or(col: Column, default: str | None) -> Column:
    """The text, or the default when it is null or empty."""
    return F.when(col.isNull() | (col == ""), F.lit(default)).otherwise(col)


def number_or(col: Column, default: float) -> Column:
    """The number, or the default when it is null, NaN or zero."""
    return F.when(col.isNull() | (col == 0) | F.isnan(col), F.lit(default)).otherwise(col)


def int_prefix(text: Column) -> Column:
    """Whole number at the start of a text ('4.7' is 4, '0x1F' is 31), NULL when there is none."""
    hexadecimal = F.regexp_extract(text, HEX_PREFIX, 1)
    magnitude = F.conv(hexadecimal, 16, 10).try_cast("double")
    return F.when(
        hexadecimal != "", F.when(text.rlike(rf"(?U)^{WHITE_SPACE}*-"), -magnitude).otherwise(magnitude)
    ).otherwise(F.regexp_extract(text, INTEGER_PREFIX, 1).try_cast("double"))


def float_prefix(text: Column) -> Column:
    """Decimal number at the start of a text ('0.3abc' is 0.3), NULL when there is none."""
    return (
        F.when(text.rlike(INFINITY_PREFIX), F.concat(F.regexp_extract(text, INFINITY_PREFIX, 1), F.lit("Infinity")))
        .otherwise(F.regexp_extract(text, FLOAT_PREFIX, 1))
        .try_cast("double")
    )


def member(value: Column, name: str) -> Column:
    """A member of a JSON object; NULL when missing or when the value is not an object."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


# Names under which a JSON value's schema shows each kind of value.
_KIND_PATTERNS = {
    "null": "VOID",
    "boolean": "BOOLEAN",
    "string": "STRING",
    "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT",
    "array": "ARRAY<.*",
    "object": "OBJECT<.*",
}
_FALSY_JSON = ("null", "false", '""', "0", "-0", "0.0", "-0.0")


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether the JSON value is of one of the kinds. Never NULL: a missing value is of no kind."""
    pattern = "|".join(_KIND_PATTERNS[name] for name in kinds)
    return F.coalesce(F.schema_of_variant(value).rlike(f"^(?:{pattern})$"), F.lit(False))


def is_truthy(value: Column) -> Column:
    """False for missing, null, false, 0 and ''; true for everything else, so also for 'no' and []."""
    return F.coalesce(~F.to_json(value).isin(*_FALSY_JSON), F.lit(False))


def truthy_text(value: Column, default: str) -> Column:
    """Text form of a value, or the default when the value is falsy."""
    return F.when(is_truthy(value), as_text(value)).otherwise(F.lit(default))


def with_exact_json(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Add the parsed text, which must be one JSON document and nothing else; NULL otherwise.

    The built-in parser ignores whatever follows the first document. Trailing text breaks at least one of
    the two wrappings below, and a second document makes the array longer than one. The wrappings are columns
    of their own so that each text is parsed twice and not once per reference.
    """
    text = F.col(text_col)
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    documents = F.try_variant_get("_in_list", "$", "array<variant>")
    return (
        df.withColumns({"_in_list": in_list, "_as_member": as_member})
        .withColumn("_documents", documents)
        .withColumn(name, F.when((F.size("_documents") == 1) & F.col("_as_member").isNotNull(), F.get("_documents", 0)))
        .drop("_in_list", "_as_member", "_documents")
    )
