from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from echolens.operators import deadletter, jobs, ops, query

NOW = datetime(2024, 6, 1)
SCHEMA = "id string, type string, status string, created_at timestamp"


def job_frame(spark, counts):
    data = [
        (f"{kind}-{status}-{i:03d}", kind, status, NOW - timedelta(hours=i))
        for (kind, status), n in counts.items()
        for i in range(n)
    ]
    return spark.createDataFrame(data, SCHEMA)


COUNTS = {
    ("scrape_reviews", "completed"): 60, ("scrape_reviews", "failed"): 11, ("scrape_reviews", "waiting"): 7,
    ("label_reviews", "completed"): 2, ("label_reviews", "failed"): 1, ("label_reviews", "active"): 8,
}


def dlq_frame(spark, n, reason="Network timeout", kind="label_reviews"):
    data = [(f"d{i:03d}", kind, "failed", NOW - timedelta(days=i), reason, i) for i in range(n)]
    failed = spark.createDataFrame(data, "id string, type string, status string, created_at timestamp, error_message string, attempts int")
    return deadletter.to_dead_letters(failed, failed["created_at"])


def test_stats_cover_all_types(spark, rows):
    stats = rows(jobs.queue_stats(job_frame(spark, COUNTS)), "type_ord")
    assert [s["type"] for s in stats] == ["scrape_reviews", "label_reviews", "process_results", "cleanup_data", "export_data"]
    assert (stats[0]["completed"], stats[0]["failed"], stats[0]["waiting"], stats[4]["failed"]) == (60, 11, 7, 0)


def test_health(spark, rows):
    frame = job_frame(spark, COUNTS)
    got = rows(jobs.queue_health(frame, dlq_frame(spark, 3)), "type_ord")
    assert [g["status"] for g in got] == ["degraded"] + ["healthy"] * 4
    assert {g["overall_status"] for g in got} == {"healthy"} and got[0]["total_failed"] == 12 and got[1]["dlq_total"] == 3
    assert rows(jobs.queue_health(frame, dlq_frame(spark, 51)))[0]["overall_status"] == "unhealthy"
    assert rows(jobs.queue_health(frame, dlq_frame(spark, 0), "degraded"))[0]["overall_status"] == "degraded"
    assert rows(jobs.queue_health(frame, dlq_frame(spark, 0), "unhealthy"))[0]["overall_status"] == "unhealthy"
    many = job_frame(spark, {("scrape_reviews", "failed"): 21})
    assert rows(jobs.queue_health(many, dlq_frame(spark, 0)))[0]["overall_status"] == "degraded"


def test_processing_stats(spark, rows):
    got = {r["type"]: r for r in rows(jobs.processing_stats(job_frame(spark, COUNTS), 120_000))}
    scrape, label, idle = got["scrape_reviews"], got["label_reviews"], got["export_data"]
    assert (scrape["jobs_per_minute"], scrape["success_rate"]) == (36, 0.85)
    assert (label["jobs_per_minute"], label["success_rate"], idle["success_rate"]) == (2, 0.67, 1.0)
    assert (scrape["total_active_workers"], scrape["average_queue_depth"]) == (8, 1)
    assert scrape["oldest_waiting_job"] == NOW - timedelta(hours=6)
    recent = rows(jobs.processing_stats(job_frame(spark, COUNTS), since=NOW - timedelta(hours=4)))
    assert {r["type"]: r["jobs_per_minute"] for r in recent}["scrape_reviews"] == 10


def test_recent_jobs(spark, rows):
    got = [r for r in rows(jobs.recent_jobs(job_frame(spark, COUNTS))) if r["type"] == "label_reviews"]
    assert sorted(r["status"] for r in got) == ["active"] * 5 + ["completed"] * 2 + ["failed"]
    scrape = [r for r in rows(jobs.recent_jobs(job_frame(spark, COUNTS)), "position") if r["type"] == "scrape_reviews"]
    assert len(scrape) == 10 and scrape[0]["created_at"] == NOW


def test_keep_last_and_clean(spark):
    frame = job_frame(spark, {("scrape_reviews", "completed"): 120, ("scrape_reviews", "failed"): 110, ("scrape_reviews", "active"): 130})
    kept = {r["status"]: r["count"] for r in jobs.keep_last_finished(frame).groupBy("status").count().collect()}
    assert kept == {"completed": 50, "failed": 100, "active": 130}
    left, removed = jobs.clean_queue(frame, NOW, limit=10)
    assert left.count() + removed.count() == 360
    assert sorted(r.id for r in removed.where("status = 'failed'").collect()) == [f"scrape_reviews-failed-{i:03d}" for i in range(100, 110)]
    left, removed = jobs.clean_queue(frame, NOW, limit=0)
    assert removed.count() == (120 - 24) + (110 - 24) and left.count() == 360 - removed.count()


def test_options(spark, rows):
    schema = "option_priority int, option_delay int, option_attempts int, priority int, delay int, retry_attempts int"
    frame = spark.createDataFrame([(None, 0, 4, 7, 9, 2), (0, None, None, 0, 0, 0), (2, 5, 0, 7, 9, 2)], schema)
    got = [(r["resolved_priority"], r["resolved_delay"], r["resolved_attempts"]) for r in rows(jobs.resolve_job_options(frame))]
    assert got == [(7, 9, 4), (5, 0, 3), (2, 5, 2)]


def test_dead_letter_stats_and_pages(spark, rows):
    dlq = dlq_frame(spark, 120).unionByName(dlq_frame(spark, 2, None, "scrape_reviews"))
    stats = {r["type"]: r for r in rows(deadletter.dlq_stats(dlq))}
    assert (stats["label_reviews"]["total"], stats["label_reviews"]["newest_failure"]) == (120, NOW)
    assert (stats["export_data"]["total"], stats["export_data"]["oldest_failure"]) == (0, None)
    assert {(r["type"], r["failure_reason"]): r["jobs"] for r in rows(deadletter.dlq_reasons(dlq))} == {
        ("label_reviews", "Network timeout"): 120, ("scrape_reviews", "Unknown"): 2,
    }
    overview = {r["type"]: r for r in rows(deadletter.dlq_overview(dlq))}
    assert [j["id"] for j in overview["label_reviews"]["recent_jobs"]] == [f"dlq_d00{i}" for i in range(5)]
    assert overview["export_data"]["recent_jobs"] is None

    def page(*bounds):
        chosen = deadletter.dead_letter_page(dlq, *bounds).where("original_job_type = 'label_reviews'")
        return sorted(r.original_job_id for r in chosen.collect())

    assert page() == [f"d{i:03d}" for i in range(100)]
    assert page(5, 9) == [f"d{i:03d}" for i in range(5, 10)]
    assert page(0, -1) == [f"d{i:03d}" for i in range(120)]
    assert page(100, -1) == [f"d{i:03d}" for i in range(100, 120)]


def test_retry(spark):
    dlq = dlq_frame(spark, 15).unionByName(dlq_frame(spark, 3, "Rate limit").withColumn("id", deadletter.F.concat(deadletter.F.lit("x"), "id")))
    retried, rest = deadletter.retry_by_reason(dlq, "label_reviews", "Network timeout")
    assert sorted(r.id for r in retried.collect()) == [f"retry_d{i:03d}" for i in range(10)] and rest.count() == 8
    assert {(r.priority, r.delay, r.max_attempts) for r in retried.collect()} == {(5, 0, 3)}
    assert deadletter.retry_by_reason(dlq, "label_reviews", "Network timeout", 0)[0].count() == 10
    assert deadletter.retry_by_reason(dlq, "label_reviews", "Network")[0].count() == 0
    retried, rest = deadletter.retry_dead_letter(dlq, ["dlq_d001"], priority=1)
    assert (retried.first().id, retried.first().priority, rest.count()) == ("retry_d001", 1, 17)
    with pytest.raises(LookupError, match="nope"):
        deadletter.retry_dead_letter(dlq, ["dlq_d001", "nope"])


def test_retention(spark):
    dlq = dlq_frame(spark, 40)
    assert deadletter.clean_dead_letters(dlq, NOW)[1].count() == 0  # all still waiting
    closed = dlq.withColumn("status", deadletter.F.lit("failed"))
    kept, removed = deadletter.clean_dead_letters(closed, NOW)
    assert (kept.count(), removed.count()) == (30, 10)
    assert deadletter.cleanup(dlq, "failed_at", NOW).count() == 31
    assert deadletter.cleanup(dlq, "failed_at", NOW, dry_run=True).count() == 9


def test_health_rollup(spark, rows):
    checks = [
        ("a", "unhealthy", True, False), ("b", "unhealthy", False, False), ("c", "degraded", False, False),
        ("d", "unhealthy", True, False), ("d", "degraded", False, False), ("e", "healthy", True, True),
        ("f", "healthy", False, True), ("f", "healthy", True, None),
    ]
    frame = spark.createDataFrame(checks, "service string, status string, critical boolean, timed_out boolean")
    got = {r["service"]: r["status"] for r in rows(ops.health_rollup(frame))}
    assert got == {"a": "unhealthy", "b": "healthy", "c": "degraded", "d": "unhealthy", "e": "unhealthy", "f": "healthy"}


def test_logs(spark, rows):
    logs = spark.createDataFrame(
        [(i, "debug" if i % 2 else "info", {"password": "p", "user": "u", "Token": "t"}) for i in range(4000)],
        "id int, level string, metadata map<string,string>",
    )
    assert rows(ops.redact_logs(logs).limit(1))[0]["metadata"] == {"user": "u", "Token": "t"}
    kept = ops.sample_debug_logs(logs)
    assert kept.where("level = 'info'").count() == 2000
    assert 140 < kept.where("level = 'debug'").count() < 260
    assert ops.sample_debug_logs(logs, 0).count() == kept.count()
    assert ops.sample_debug_logs(logs, 1.0).count() == 4000
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in ops.sample_debug_logs(logs.repartition(7)).collect())


def test_query_helpers(spark, rows):
    spark.range(5).createOrReplaceTempView("numbers")
    picked = query.run_sql(spark, "SELECT id FROM numbers WHERE id > ? ORDER BY id", [2])
    assert [r["id"] for r in rows(picked)] == [3, 4]
    assert rows(query.first_row(picked)) == [{"id": 3}]
    assert rows(query.exists_df(picked)) == [{"exists": True}] and rows(query.exists_df(picked.where("false"))) == [{"exists": False}]
    assert rows(query.count_df(picked)) == [{"count": 2}]
    assert rows(query.first_row(picked.where("false"))) == []
