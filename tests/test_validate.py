from __future__ import annotations

import json
from datetime import datetime

import pytest

from echolens.operators.validate import check_stored, validate_job_results, validate_jobs, validate_reviews

UUID = "123e4567-e89b-42d3-a456-426614174000"
BAD = [
    ("scrape_reviews", {}, "appId: required"),
    ("scrape_reviews", {"appId": ""}, "appId: empty"),
    ("scrape_reviews", {"appId": 5}, "appId: type"),
    ("scrape_reviews", {"appId": "a", "countries": []}, "countries: empty"),
    ("scrape_reviews", {"appId": "a", "countries": ["usa"]}, "countries: item"),
    ("scrape_reviews", {"appId": "a", "countries": ["u"]}, "countries: item"),
    ("scrape_reviews", {"appId": "a", "countries": [12]}, "countries: item"),
    ("scrape_reviews", {"appId": "a", "countries": None}, "countries: type"),
    ("scrape_reviews", {"appId": "a", "pages": 0}, "pages: range"),
    ("scrape_reviews", {"appId": "a", "pages": 11}, "pages: range"),
    ("scrape_reviews", {"appId": "a", "pages": 2.5}, "pages: integer"),
    ("scrape_reviews", {"appId": "a", "pages": "5"}, "pages: type"),
    ("scrape_reviews", {"appId": "a", "sortMethods": ["newest"]}, "sortMethods: item"),
    ("scrape_reviews", {"appId": "a", "throttleMs": 5001}, "throttleMs: range"),
    ("scrape_reviews", {"appId": "a", "priority": 0}, "priority: range"),
    ("scrape_reviews", {"appId": "a", "priority": 11}, "priority: range"),
    ("scrape_reviews", {"appId": "a", "retryAttempts": 6}, "retryAttempts: range"),
    ("scrape_reviews", {"appId": "a", "delay": -1}, "delay: range"),
    ("scrape_reviews", {"appId": "a", "correlationId": "batch-1-a"}, "correlationId: uuid"),
    ("label_reviews", {"reviewIds": []}, "reviewIds: empty"),
    ("label_reviews", {"reviewIds": [""]}, "reviewIds: item"),
    ("label_reviews", {"reviewIds": ["a"], "batchSize": 0}, "batchSize: range"),
    ("label_reviews", {"reviewIds": ["a"], "batchSize": 101}, "batchSize: range"),
    ("process_results", {"sourceJobId": "j", "resultType": "invalid_type"}, "resultType: enum"),
    ("process_results", {"sourceJobId": "j", "resultType": "exported_data", "outputFormat": "xml"}, "outputFormat: enum"),
    ("cleanup_data", {"targetType": "other"}, "targetType: enum"),
    ("cleanup_data", {"targetType": "temp_files", "olderThanDays": 0}, "olderThanDays: range"),
    ("cleanup_data", {"targetType": "temp_files", "dryRun": "no"}, "dryRun: type"),
    ("export_data", {"appId": "a", "format": "pdf"}, "format: enum"),
    ("export_data", {"appId": "a", "dateRange": {"startDate": "invalid-date", "endDate": "2024-01-01T00:00:00Z"}}, "dateRange: startDate"),
    ("export_data", {"appId": "a", "dateRange": {"startDate": "2024-01-01T00:00:00Z"}}, "dateRange: endDate"),
    ("unknown_type", {"appId": "a"}, "type: unknown"),
    (None, {"appId": "a"}, "type: unknown"),
]
GOOD = [
    (
        "scrape_reviews", {"appId": "a", "extra": 1},
        {"appId": "a", "countries": ["us"], "pages": 5, "sortMethods": ["recent"], "throttleMs": 500, "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
    (
        "scrape_reviews", {"appId": "a", "pages": 10.0, "countries": ["gb", "us"], "correlationId": UUID},
        {"appId": "a", "countries": ["gb", "us"], "pages": 10, "sortMethods": ["recent"], "throttleMs": 500, "correlationId": UUID, "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
    (
        "label_reviews", {"reviewIds": ["review1"]},
        {"reviewIds": ["review1"], "batchSize": 20, "model": "gpt-4.1-mini", "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
    (
        "process_results", {"sourceJobId": "j", "resultType": "scraped_reviews"},
        {"sourceJobId": "j", "resultType": "scraped_reviews", "outputFormat": "database", "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
    (
        "cleanup_data", {"targetType": "old_reviews"},
        {"targetType": "old_reviews", "olderThanDays": 30, "dryRun": False, "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
    (
        "export_data", {"appId": "a"},
        {"appId": "a", "format": "csv", "includeLabels": True, "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
    (
        "export_data", {"appId": "a", "dateRange": {"startDate": "2024-01-01T00:00:00.000Z", "endDate": "2024-01-31T23:59:59Z"}},
        {"appId": "a", "format": "csv", "includeLabels": True, "dateRange": {"startDate": "2024-01-01T00:00:00.000Z", "endDate": "2024-01-31T23:59:59Z"}, "priority": 5, "retryAttempts": 3, "delay": 0},
    ),
]


def test_jobs(spark):
    data = [(i, kind, json.dumps(payload)) for i, (kind, payload, _) in enumerate(BAD + GOOD)]
    data += [(900, "export_data", "not json"), (901, "export_data", "[1]"), (902, "export_data", None)]
    ok, bad = validate_jobs(spark.createDataFrame(data, "id int, type string, payload string"))
    errors = {r.id: r.errors for r in bad.collect()}
    accepted = {r.id: json.loads(r.payload) for r in ok.collect()}
    assert {i: e for i, e in errors.items() if i < 900} == {i: [code] for i, (_, _, code) in enumerate(BAD)}
    assert [errors[i] for i in (900, 901, 902)] == [["payload: type"]] * 3
    assert accepted == {len(BAD) + i: expected for i, (_, _, expected) in enumerate(GOOD)}


def test_several_errors(spark):
    payload = json.dumps({"pages": 0, "priority": 99})
    _, bad = validate_jobs(spark.createDataFrame([(1, "scrape_reviews", payload)], "id int, type string, payload string"))
    assert bad.first().errors == ["appId: required", "pages: range", "priority: range"]


@pytest.mark.parametrize(
    ("result", "expected"),
    [
        ({"success": True}, []),
        ({"success": False, "error": "x", "data": {}, "processingTime": 0, "itemsProcessed": 5}, []),
        ({"message": "m"}, ["success: required"]),
        ({"success": "yes"}, ["success: type"]),
        ({"success": True, "processingTime": -1, "itemsProcessed": 1.5}, ["processingTime: range", "itemsProcessed: integer"]),
        ({"success": True, "data": "x"}, ["data: type"]),
    ],
)
def test_job_results(spark, result, expected):
    ok, bad = validate_job_results(spark.createDataFrame([(json.dumps(result),)], "result string"))
    assert [r.errors for r in bad.collect()] == ([expected] if expected else [])
    assert ok.count() == (0 if expected else 1)


REVIEW = {
    "id": "a", "user_name": "u", "user_url": None, "version": "1", "score": 3, "title": "t", "text": "x",
    "url": "https://example.com/r", "date": datetime(2024, 1, 1), "helpful_votes": None, "country": "us",
}
SCHEMA = (
    "id string, user_name string, user_url string, version string, score int, title string, text string, url string, "
    "date timestamp, helpful_votes int, country string"
)


def test_reviews(spark):
    changes = [
        ({}, []),
        ({"id": None}, ["id: required"]),
        ({"score": 0}, ["score: range"]),
        ({"score": 6, "country": "usa"}, ["score: range", "country: length"]),
        ({"url": "not a url"}, ["url: format"]),
        ({"url": "http://"}, ["url: format"]),
        ({"url": "mailto:a@b"}, []),
        ({"url": None}, []),
        ({"helpful_votes": -1}, ["helpful_votes: range"]),
        ({"date": None}, ["date: required"]),
        ({"user_url": "x"}, ["user_url: format"]),
    ]
    data = [tuple((REVIEW | {"version": str(i)} | change).values()) for i, (change, _) in enumerate(changes)]
    ok, bad = validate_reviews(spark.createDataFrame(data, SCHEMA))
    got = {r.version: [] for r in ok.collect()} | {r.version: r.errors for r in bad.collect()}
    assert got == {str(i): errors for i, (_, errors) in enumerate(changes)}
    first = ok.where("version = '0'").first()
    assert (first.country, first.helpful_votes) == ("US", 0)
    _, strict = validate_reviews(spark.createDataFrame(data, SCHEMA), require_url=True)
    assert strict.where("version = '7'").first().errors == ["url: required"]


def test_stored_constraints(spark):
    apps = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "z")], "id string, title string")
    ok, bad = check_stored(apps, "apps")
    assert ok.count() == 0
    assert sorted((str(r.id), r.errors) for r in bad.collect()) == [
        ("None", ["id: required"]), ("a", ["id: duplicate"]), ("a", ["id: duplicate"]), ("b", ["title: required"]),
    ]
