from __future__ import annotations

import json

from pyspark.sql import functions as F

from echolens.operators.labeling import fallback_labels, labels_from_responses, parse_responses
from echolens.operators.normalize import clean_labels, restrict_to_taxonomy

FIELDS = ("review_id", "theme", "sentiment", "severity", "feature_request", "direct_quote", "confidence")
DEFAULT = ("", "General Feedback", "neutral", 1, False, "", 0.5)


def cleaned(spark, elements):
    frame = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(elements)], "i int, j string")
    got = clean_labels(frame.select("i", F.parse_json("j").alias("element")), "m").orderBy("i").collect()
    return [tuple(float(row[f]) if f == "confidence" else row[f] for f in FIELDS) for row in got]


def test_clean_labels(spark):
    full = {
        "reviewId": "review-1", "theme": "Features", "sentiment": "positive", "severity": 1, "featureRequest": False,
        "directQuote": "nice", "confidence": 0.95,
    }
    wild = {
        "reviewId": "r", "theme": "Invalid Theme", "sentiment": "invalid-sentiment", "severity": 10,
        "featureRequest": "yes", "directQuote": "x" * 200, "confidence": 2.5,
    }
    assert cleaned(
        spark,
        [
            full,
            {},
            wild,
            {"severity": "4.7", "confidence": 0, "featureRequest": "false"},
            {"severity": -3, "confidence": -0.2, "featureRequest": 0},
            {"severity": "3abc", "confidence": "0.3abc", "featureRequest": ""},
            {"severity": 0.5, "theme": ""},
            {"severity": [4], "sentiment": ["positive"], "featureRequest": []},
            {"severity": None, "theme": None, "reviewId": 7},
            5,
            "text",
        ],
    ) == [
        ("review-1", "Features", "positive", 1, False, "nice", 0.95),
        DEFAULT,
        ("r", "Invalid Theme", "neutral", 5, True, "x" * 100, 1.0),
        ("", "General Feedback", "neutral", 4, True, "", 0.5),
        ("", "General Feedback", "neutral", 1, False, "", 0.0),
        ("", "General Feedback", "neutral", 3, False, "", 0.3),
        DEFAULT,
        ("", "General Feedback", "neutral", 1, True, "", 0.5),
        ("7", "General Feedback", "neutral", 1, False, "", 0.5),
        DEFAULT,
        DEFAULT,
    ]


def test_strict_taxonomy(spark):
    labels = spark.createDataFrame([("Features",), ("Other",)], "theme string")
    assert [r.theme for r in restrict_to_taxonomy(labels, ["Features"]).collect()] == ["Features", "General Feedback"]


RESPONSES = [
    ('[{"reviewId":"a"}]', 1),
    ('{"results":[{"reviewId":"a"},{}]}', 2),
    ("[]", 0),
    ('{"results":[]}', 0),
    ("[5]", 1),
    ("", None),
    (None, None),
    ("invalid json response", None),
    ('[{"reviewId":"a"}] trailing', None),
    ('{"a":1}', None),
    ("null", None),
    ("5", None),
    ("[null]", None),
    ('[{"directQuote": 123}]', None),
    ('[{"directQuote": true}]', None),
    ('[{"directQuote": 0}]', 1),
    ('[{"directQuote": null}]', 1),
    ('{"results":[{}],"results":[{},{}]}', 2),
]


def responses(spark):
    data = [(i, [f"r{i}a", f"r{i}b"], content) for i, (content, _) in enumerate(RESPONSES)]
    return spark.createDataFrame(data, "batch_no int, review_ids array<string>, content string")


def test_parse_responses(spark):
    elements, failed = parse_responses(responses(spark))
    counts = {r.batch_no: r["count"] for r in elements.groupBy("batch_no").count().collect()}
    bad = {r.batch_no for r in failed.collect()}
    for i, (content, expected) in enumerate(RESPONSES):
        assert (i in bad) == (expected is None), content
        assert counts.get(i, 0) == (expected or 0), content


def test_fallback(spark):
    batches = responses(spark)
    members = batches.select("batch_no", F.explode("review_ids").alias("id"))
    failed = parse_responses(batches)[1]
    got = fallback_labels(failed, members, "m").collect()
    bad = [i for i, (_, expected) in enumerate(RESPONSES) if expected is None]
    assert sorted(r.review_id for r in got) == sorted(f"r{i}{x}" for i in bad for x in "ab")
    assert {tuple(r[f] for f in FIELDS[1:6]) + (float(r.confidence),) for r in got} == {
        ("General Feedback", "neutral", 1, False, "", 0.0)
    }


def test_one_pass_gives_the_union(spark):
    batches = responses(spark)
    got = labels_from_responses(batches, "m").drop("answer_ord")
    elements, failed = parse_responses(batches)
    members = batches.select("batch_no", F.explode("review_ids").alias("id"))
    expected = clean_labels(elements.select("element"), "m").unionByName(
        fallback_labels(failed, members, "m").drop("batch_no")
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(*got.columns).collect()))
