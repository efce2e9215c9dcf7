from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from echolens.operators import insights as I
from echolens.operators.normalize import labels_to_analyses, normalize_analyses
from echolens.plans.report import insight_report
from echolens.sources.readers import read_analyses

RECORDS = [
    "null",
    '{"id":"a"}',
    '{"id":"b","analysis":null}',
    '{"id":"c","analysis":"text"}',
    '{"id":"d","analysis":[]}',
    '{"id":"e","analysis":{}}',
    '{"analysis":{"theme":"A","sentiment":"negative","severity":"4"}}',
    '{"analysis":{"theme":"A","sentiment":"negative","severity":4}}',
    '{"analysis":{"theme":"A","sentiment":"mixed"}}',
    '{"analysis":{"theme":"A","feature_request":"y"}}',
]


def analyses(spark, records=RECORDS):
    frame = spark.createDataFrame(list(enumerate(records)), "ord bigint, j string")
    return normalize_analyses(frame.select("ord", F.parse_json("j").alias("record")))


def test_edge_records(spark, rows):
    report = insight_report(analyses(spark))
    assert rows(report.totals) == [
        {"total_reviews": 10, "skipped_reviews": 4, "processed_reviews": 6, "feature_requests": 0}
    ]
    themes = {r["theme"]: r for r in rows(report.themes)}
    a, unknown = themes["A"], themes["Unknown Theme"]
    assert (a["mentions"], a["positive"], a["negative"], a["neutral"], a["average_severity"]) == (4, 0, 2, 2, 2.5)
    assert (unknown["mentions"], unknown["neutral"], unknown["average_severity"]) == (2, 2, 0.0)
    assert rows(report.requests) == []
    got = [(r["category"], r["ord"], r["message"]) for r in rows(report.swot, "category", "ord")]
    assert got == [
        ("opportunities", 1, "Limited explicit feature requests identified in this dataset."),
        ("opportunities", 2, "Opportunity to improve user satisfaction by addressing issues related to 'A'."),
        ("weaknesses", 1, "Significant user dissatisfaction with 'A' (50% Negative of 4 mentions, Avg Severity: 2.50)."),
        ("weaknesses", 2, "Notable overall negative sentiment across reviews (33% Negative of processed)."),
    ]
    report_rows = rows(I.swot_report(report.swot), "section", "ord")
    assert [r["category"] for r in report_rows] == [
        "strengths", "weaknesses", "weaknesses", "opportunities", "opportunities", "threats",
    ]
    assert report_rows[0]["line"].startswith("(No significant strengths")
    document = json.loads(I.swot_json(report.swot).first()["swot"])
    assert list(document) == ["strengths", "weaknesses", "opportunities", "threats"]
    assert document["threats"] == [] and len(document["weaknesses"]) == 2


def test_strength_threat_and_requests(spark, rows):
    def record(theme, sentiment, severity=1, fr="N", quote=""):
        return json.dumps(
            {"analysis": {"theme": theme, "sentiment": sentiment, "severity": severity, "feature_request": fr, "direct_quote": quote}}
        )

    data = [record("Good", "positive", fr="Y", quote="q0")] * 13 + [record("O'Neil", "negative", 5, "Y", "q1")] * 7
    report = insight_report(analyses(spark, data))
    messages = {(r["category"], r["ord"]): r["message"] for r in rows(report.swot)}
    assert messages[("strengths", 1)] == "High user satisfaction with 'Good' (100% Positive of 13 mentions)."
    assert messages[("strengths", 2)] == "Generally positive sentiment across reviews (65% Positive of processed)."
    assert messages[("threats", 1)].startswith("High severity issues reported for 'O'Neil' (Avg Severity: 5.00)")
    assert messages[("opportunities", 1)].endswith("(20 requests identified, ~100.0% of processed reviews).")
    assert messages[("opportunities", 2)] == "Top themes associated with feature requests: Good (13), O'Neil (7)."
    assert messages[("opportunities", 3)].endswith("high-severity issues in 'O'Neil'.")
    quotes = rows(I.feature_request_quotes(analyses(spark, data), 15))
    assert [q["ord"] for q in quotes] == list(range(15)) and quotes[14]["quote"] == "q1"


def test_nothing_processed(spark, rows):
    report = insight_report(analyses(spark, ["null", '{"id":"x"}']))
    assert rows(report.swot) == []
    assert rows(report.overall) == [{"positive": 0, "negative": 0, "neutral": 0}]
    empty = insight_report(analyses(spark).where("false"))
    assert rows(empty.swot) == [] and rows(empty.totals)[0]["total_reviews"] == 0


def test_averages(spark):
    def average(values):
        frame = spark.createDataFrame([(v,) for v in values], "confidence double")
        return I.average_confidence(frame).first()[0]

    assert average([0.8, 0.9, 0.7]) == 0.8
    assert average([0.95, 0.90]) == 0.93
    assert average([]) == 0


def test_breakdown_has_three_keys(spark, rows):
    labels = spark.createDataFrame([("positive",), ("positive",), ("negative",)], "sentiment string")
    assert rows(I.sentiment_breakdown(labels)) == [{"positive": 2, "neutral": 0, "negative": 1}]


def test_bridge(spark):
    labels = spark.createDataFrame([(True,), (False,), (None,)], "feature_request boolean")
    assert [r[0] for r in labels_to_analyses(labels).collect()] == ["Y", "N", "N"]


def test_job_summary(spark, rows):
    jobs = spark.createDataFrame([("j1", ["a", "b"]), ("j2", [f"x{i}" for i in range(12)])], "job_id string, review_ids array<string>")
    labels = spark.createDataFrame([("a", "positive", 0.95), ("b", "negative", 0.9)], "review_id string, sentiment string, confidence double")
    good, bad = rows(I.label_job_summary(labels, jobs), "job_id")
    assert (good["success"], good["items_processed"], good["average_confidence"], good["positive"]) == (True, 2, 0.93, 1)
    assert good["message"] == "Successfully labeled 2 reviews"
    assert (bad["success"], bad["items_processed"]) == (False, 0)
    assert bad["failed_review_ids"] == [f"x{i}" for i in range(10)]
    assert bad["error"] == "No reviews found for provided IDs: x0, x1, x2, x3, x4..."


def test_job_results_have_their_time(spark, rows):
    from datetime import datetime

    ids = [f"x{i}" for i in range(12)]
    summary = I.label_job_summary(
        spark.createDataFrame([("a", "positive", 0.95), ("x0", "negative", 0.5)], "review_id string, sentiment string, confidence double"),
        spark.createDataFrame([("j1", ["a"]), ("j2", ["q"]), ("j3", ids)], "job_id string, review_ids array<string>"),
    )
    start = datetime(2024, 1, 1)
    runs = [("j1", ["a"], start, datetime(2024, 1, 1, 0, 0, 2), None), ("j2", ["q"], start, start, None),
            ("j3", ids, start, datetime(2024, 1, 1, 0, 0, 0, 7000), "boom"), ("j4", ["z"], start, None, "lost")]
    runs = spark.createDataFrame(runs, "job_id string, review_ids array<string>, started_at timestamp, finished_at timestamp, error string")
    a, b, c, d = rows(I.label_results(summary, runs), "job_id")
    assert (a["success"], a["processing_time"], a["items_processed"], a["error"]) == (True, 2000, 1, None)
    assert (b["success"], b["processing_time"], b["error"][:16]) == (False, 0, "No reviews found")
    assert (c["success"], c["processing_time"], c["items_processed"], c["error"], c["failed_review_ids"], c["message"]) == (False, 7, 0, "boom", ids[:10], None)
    assert (d["success"], d["processing_time"], d["error"]) == (False, None, "lost")


def test_empty_backlog_is_a_success(spark, rows):
    labels = spark.createDataFrame([], "sentiment string, confidence double")
    assert rows(I.backlog_summary(labels))[0] == {
        "success": True, "message": "No unlabeled reviews found", "items_processed": 0, "average_confidence": 0.0,
        "positive": 0, "neutral": 0, "negative": 0,
    }


def test_read_analyses_document(spark, tmp_path, rows):
    path = tmp_path / "a.json"
    path.write_text('{"analyses": [%s]}' % ", ".join(RECORDS))
    stats = I.insight_stats(normalize_analyses(read_analyses(spark, str(path))))
    assert rows(I.insight_totals(stats))[0]["skipped_reviews"] == 4
    path.write_text('{"analyses": 5}')
    with pytest.raises(Exception, match="no array member 'analyses'"):
        read_analyses(spark, str(path)).collect()
