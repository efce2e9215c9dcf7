from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolens.functions.coercion import float_prefix, int_prefix, is_truthy, number_or, text_or, with_exact_json
from echolens.functions.rounding import fixed, fixed_text, half_up
from echolens.functions.text import sanitize_name


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_sanitize_name(spark):
    names = ['My/App\\Name:With*Invalid?"Characters<>|', "My App Name With Spaces", "", "   ", "  Valid App Name  "]
    assert column(spark, names, "string", sanitize_name) == [
        "MyAppNameWithInvalidCharacters", "My_App_Name_With_Spaces", "app", "app", "Valid_App_Name",
    ]
    assert column(spark, names, "string", lambda c: sanitize_name(c, legacy=True)) == [
        "MyAppNameWithInvalidCharacters", "My_App_Name_With_Spaces", "app", "_", "_Valid_App_Name_",
    ]


def test_sanitize_name_trims_wide_blanks(spark):
    assert column(spark, [" A　B﻿", "\u0085A"], "string", sanitize_name) == ["A_B", "\u0085A"]


def test_defaults(spark):
    assert column(spark, [None, "", "x", " "], "string", lambda c: text_or(c, "d")) == ["d", "d", "x", " "]
    values = [None, 0.0, float("nan"), 2.5]
    assert column(spark, values, "double", lambda c: number_or(c, 7.0)) == [7.0, 7.0, 7.0, 2.5]


def test_number_prefixes(spark):
    texts = ["4.7", "3abc", " -3", "abc", "", "0x1F", "-0x2", "99999999999999999999", None, " 5"]
    assert column(spark, texts, "string", int_prefix) == [4, 3, -3, None, None, 31, -2, 1e20, None, 5]
    texts = ["0.3abc", ".5", "-0.2", "1e-1x", "Infinity", "-Infinity", "x1", "1.", None]
    assert column(spark, texts, "string", float_prefix) == [0.3, 0.5, -0.2, 0.1, math.inf, -math.inf, None, 1.0, None]


def test_truthiness(spark):
    falsy = ["null", "false", "0", "0.0", "-0", '""']
    truthy = ["true", "1", '"no"', '"false"', '"0"', "[]", "{}", "0.5", '" "']
    got = column(spark, falsy + truthy + [None], "string", lambda c: is_truthy(F.try_parse_json(c)))
    assert got == [False] * len(falsy) + [True] * len(truthy) + [False]


def test_exact_json_rejects_trailing_text(spark):
    good = ["[1]", ' {"a": 1} ', "5", "null", '"x"']
    bad = ["[1] x", "[1],[2]", "[1] ]", "[1] }", '[1], "x": 2', "", "x", None, "{", "1] [2", '1} {"a":2']
    frame = spark.createDataFrame(list(enumerate(good + bad)), "i int, v string")
    got = [r[0] for r in with_exact_json(frame, "v", "j").orderBy("i").select(F.col("j").isNotNull()).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_rounding_examples(spark):
    assert column(spark, [1.005, 0.925, 2.5, 0.125], "double", lambda c: half_up(c, 2)) == [1.0, 0.93, 2.5, 0.13]
    # Exact values: 1.005 is just below the tie, 1.115 too, 0.125 is a tie.
    assert column(spark, [1.005, 1.115, 0.125, 2.5], "double", lambda c: fixed_text(c, 2)) == ["1.00", "1.11", "0.13", "2.50"]
    assert column(spark, [0.49999999999999994, 0.5, 33.333], "double", lambda c: fixed_text(c, 0)) == ["0", "1", "33"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.integers(1, 1000)), min_size=1, max_size=200))
def test_fixed_rounds_the_exact_value(spark, fractions):
    values = [a / b for a, b in fractions]
    expected = [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert column(spark, values, "double", lambda c: fixed(c, 2)) == expected
