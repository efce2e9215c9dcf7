"""Answers must not depend on which branch a size parameter takes, nor lose rows whose group or key is NULL."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echolens.operators import backlog, deadletter, jobs, labeling, merge, ops
from echolens.operators.crawl import apply_early_stop
from echolens.operators.ordinals import first_per_group
from echolens.streaming import reviews as streams

NOW = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def job_rows(spark):
    kinds = ["scrape_reviews", None, "label_reviews", None]
    rows = [(i, kinds[i % 4], "completed" if i % 3 else "failed", NOW - timedelta(days=40, hours=i)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, type string, status string, created_at timestamp").repartition(4)


@pytest.mark.parametrize("n", [1, 7, 100, 1001, 5000])
def test_first_per_group_with_null_groups(job_rows, n):
    got = first_per_group(job_rows, ["type"], [F.col("created_at").desc(), F.col("id").desc()], n).collect()
    expected = {}
    for row in sorted(job_rows.collect(), key=lambda r: r.id):
        expected.setdefault(row.type, []).append(row.id)
    assert sorted((str(r.type), r.position, r.id) for r in got) == sorted(
        (str(t), k, i) for t, ids in expected.items() for k, i in enumerate(ids[:n], 1)
    )


def test_pages_quotas_and_batches_with_null_groups(job_rows):
    assert jobs.keep_last_finished(job_rows, 5000, 5000).count() == 60
    small, large = jobs.keep_last_finished(job_rows, 100, 100), jobs.keep_last_finished(job_rows, 2000, 2000)
    assert small.count() == large.count() == 60
    kept, removed = jobs.clean_queue(job_rows, NOW, limit=2000)
    assert kept.count() == 0 and removed.count() == 60
    letters = deadletter.to_dead_letters(job_rows, NOW)
    pages = [deadletter.dead_letter_page(letters, 0, end).select("id").collect() for end in (99, 1999, -1)]
    assert [len(p) for p in pages] == [60] * 3
    numbered = backlog.number_batches(job_rows, [F.col("id").asc()], 7, ["type"])
    assert numbered.count() == 60 and numbered.where("type IS NULL AND batch_no = 0").count() == 7


@pytest.mark.parametrize("rows", [None, 4])
def test_merge_with_null_keys(spark, rows):
    columns = "id string, score int, title string, text string, helpful_votes int, created_at timestamp, updated_at timestamp"
    old = datetime(2023, 1, 1)
    target = spark.createDataFrame([(None, 1, "t", "x", 0, old, old), ("a", 1, "t", "x", 0, old, old), ("b", 1, "t", "x", 0, old, old)], columns)
    source = spark.createDataFrame([("a", 5, "n", "y", 2), ("c", 4, "n", "z", 3), (None, 3, "n", "w", 1)], "id string, score int, title string, text string, helpful_votes int")
    merged = merge.upsert_reviews(target, source, NOW, rows).collect()
    assert sorted((str(r.id), r.score, r.title, r.created_at, r.updated_at) for r in merged) == sorted([
        ("None", 1, "t", old, old), ("a", 5, "n", old, NOW), ("b", 1, "t", old, old), ("c", 4, "n", NOW, NOW),
        ("None", 3, "n", NOW, NOW),
    ])


def test_merge_bounds_the_broadcast_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(merge, "BROADCAST_BYTES", 10)
    frame = spark.createDataFrame([("a", 1, "t", "long text", 0, NOW, NOW)], "id string, score int, title string, text string, helpful_votes int, created_at timestamp, updated_at timestamp")
    plan = merge.upsert_reviews(frame, frame, NOW, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan


def test_orphans_and_apps(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, app_id string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in merge.orphans(child, parent, "app_id", "id").collect()] == [2]
    columns = "id string, title string, created_at timestamp, updated_at timestamp"
    apps = spark.createDataFrame([("x", "second", 2), ("x", "first", 1), ("x", "third", 3)], "id string, title string, ord int").repartition(3)
    added = merge.ensure_apps(spark.createDataFrame([], columns), apps, NOW, [F.col("ord")]).collect()
    assert [(r.id, r.title) for r in added] == [("x", "first")]


def test_early_stop_keeps_lists_without_a_country(spark):
    rows = [("a", None, "recent", p, 1, None) for p in range(1, 80)] + [("a", "us", "recent", p, 1, None) for p in (1, 3)]
    pages = spark.createDataFrame(rows, "app_id string, country_code string, sort_method string, page int, n_reviews int, error string")
    kept = apply_early_stop(pages).collect()
    assert sorted((str(r.country_code), r.page) for r in kept) == [("None", p) for p in range(1, 80)] + [("us", 1)]


def test_prompts_show_what_is_missing(spark):
    reviews = [("a", "text"), ("b", None), (None, "no id")]
    rows = [(0, n, i, t) for n, (i, t) in enumerate(reviews, 1)]
    made = labeling.label_requests(spark.createDataFrame(rows, "batch_no long, position int, id string, text string"), ["x"]).first()
    assert made.user_prompt == labeling.user_prompt(reviews)
    assert made.user_prompt.count("---") == 3 and '"null"' in made.user_prompt


def test_log_sampling_rate(spark):
    logs = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("debug").alias("level"))
    assert 1_700 < ops.sample_debug_logs(logs).count() < 2_300


def _page(app, page, ids, error=None):
    return {"appId": app, "appOrd": 0, "sortMethod": "recent", "sortOrd": 0, "country": "us", "countryOrd": 0, "page": page,
            "error": error, "reviews": [{"id": i, "score": 3, "title": "t", "text": "x", "date": "2024-01-01T00:00:00Z"} for i in ids]}


def _drain(query):
    query.awaitTermination()


def test_pages_wait_for_the_gap_before_them(spark, tmp_path):
    import json

    landed, root = tmp_path / "landed", str(tmp_path / "tables")
    landed.mkdir()

    def land(name, *pages):
        (landed / name).write_text("\n".join(json.dumps(p) for p in pages))
        _drain(streams.stream_ingest(spark, str(landed), root, f"{root}/checkpoint", {"availableNow": True}, NOW))
        return {r.id for r in streams.current_reviews(spark, root).collect()}

    assert land("1.json", _page("a", 1, ["r1"]), _page("a", 3, ["r3"]), _page("b", 1, []), _page("b", 2, ["r9"])) == {"r1"}
    assert land("2.json", _page("a", 2, ["r2"])) == {"r1", "r2", "r3"}
    assert land("3.json", _page("a", 4, ["r4"], "timeout"), _page("a", 5, ["r5"])) == {"r1", "r2", "r3"}
    entries = spark.read.parquet(f"{root}/{streams.REVIEW_LOG}").groupBy("id").count().where("count > 1")
    assert entries.count() == 0  # a page is ingested once
    compact = str(tmp_path / "compact")
    streams.compact_log(spark, root, compact)
    a, b = ({r.id: r for r in streams.current_reviews(spark, x).collect()} for x in (root, compact))
    assert a == b
