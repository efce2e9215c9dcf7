from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.offline import KeywordLabeler
from echolens.streaming import jobs as job_streams
from echolens.streaming import reviews as streams

DRAIN = {"availableNow": True}
DAY1, DAY2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def land(folder, name, app, ord_, *reviews):
    folder.mkdir(exist_ok=True)
    page = {
        "appId": app, "appOrd": ord_, "sortMethod": "recent", "sortOrd": 0, "country": "us", "countryOrd": 0, "page": 1,
        "reviews": [
            {"id": i, "userName": user, "score": score, "text": text, "date": "2024-01-01T00:00:00Z"} for i, user, score, text in reviews
        ],
    }
    (folder / name).write_text(json.dumps(page))


def test_ingest_label_and_replay(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "tables")

    def ingest(as_of):
        streams.stream_ingest(spark, str(landed), root, str(tmp_path / "c1"), DRAIN, as_of).awaitTermination()

    def label():
        streams.stream_label(spark, root, str(tmp_path / "c2"), S.DEFAULT_TAXONOMY, KeywordLabeler(), trigger=DRAIN, as_of=DAY1).awaitTermination()

    land(landed, "1.json", "x", 0, ("a", "u1", 5, "great"), ("bad", "u", 9, "t"), ("a", "u1", 4, "love it"))
    ingest(DAY1)
    label()
    land(landed, "2.json", "y", 1, ("a", "u2", 1, "crash"), ("b", "u3", 2, "slow"))
    ingest(DAY2)
    label()
    now = {r.id: r for r in streams.current_reviews(spark, root).collect()}
    assert set(now) == {"a", "b"}
    a = now["a"]
    assert (a.app_id, a.user_name, a.score, a.text, a.created_at, a.updated_at) == ("x", "u1", 1, "crash", DAY1, DAY2)
    assert [r.id for r in spark.read.parquet(f"{root}/{streams.QUARANTINE}").collect()] == ["bad"]
    labels = {r.review_id: r for r in streams.current_labels(spark, root).collect()}
    # The review that came again keeps its first label; only new reviews are labeled.
    assert {k: v.sentiment for k, v in labels.items()} == {"a": "positive", "b": "negative"}

    # A replayed batch replaces its own files.
    before = spark.read.parquet(f"{root}/{streams.REVIEW_LOG}").count()
    batch = streams.explode_pages(streams.page_columns(spark.read.schema(S.REVIEW_PAGE).json(str(landed / "2.json"))))
    accepted = streams.check_reviews(batch).accepted
    streams._append(streams.reviews_to_store(accepted), root, streams.REVIEW_LOG, 1, F.lit(DAY2))
    assert spark.read.parquet(f"{root}/{streams.REVIEW_LOG}").count() == before


def test_stream_dedup_first_wins(spark, tmp_path):
    source = tmp_path / "in"
    for at, (i, v) in enumerate([("a", 1), ("a", 2), ("b", 3)]):
        spark.createDataFrame([(i, v, datetime(2024, 1, 1, 0, at))], "id string, v int, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id string, v int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = streams.stream_dedup(stream, "ts", "1 hour").writeStream.format("memory").queryName("deduped").trigger(**DRAIN).start()
    query.awaitTermination()
    assert {r.id for r in spark.table("deduped").collect()} == {"a", "b"} and spark.table("deduped").count() == 2


JOB = "id string, type string, status string, updated_at timestamp"


def land_jobs(spark, folder, *rows):
    frame = spark.createDataFrame([(i, "scrape_reviews" if i != "z" else "export_data", s, datetime(2024, 1, 1, h)) for i, s, h in rows], JOB)
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def job_status(spark, tmp_path):
    source = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "jobs"))
    query = job_streams.stream_queue_status(source, str(tmp_path / "out"), str(tmp_path / "c"), DRAIN)
    query.awaitTermination()
    return {(r.type, r.status): r.jobs for r in job_streams.queue_status(spark, str(tmp_path / "out")).collect()}


def test_each_job_counts_once_in_its_last_state(spark, tmp_path):
    jobs = tmp_path / "jobs"
    land_jobs(spark, jobs, ("a", "waiting", 1), ("b", "waiting", 1), ("a", "active", 2), ("z", "waiting", 1))
    assert job_status(spark, tmp_path) == {("scrape_reviews", "active"): 1, ("scrape_reviews", "waiting"): 1, ("export_data", "waiting"): 1}
    # Later states replace earlier ones, also told out of order or for the same time; rows without an id count each.
    land_jobs(spark, jobs, ("a", "completed", 3), ("b", "failed", 5), ("z", "active", 1))
    land_jobs(spark, jobs, ("b", "active", 4), ("a", "completed", 3), (None, "delayed", 1), (None, "delayed", 1))
    told = job_status(spark, tmp_path)
    assert told == {
        ("scrape_reviews", "completed"): 1, ("scrape_reviews", "failed"): 1, ("export_data", "active"): 1, ("scrape_reviews", "delayed"): 2,
    }
    busy = {r.type: (r.active, r.waiting) for r in job_streams.queue_activity(spark, str(tmp_path / "out")).collect()}
    assert busy == {"export_data": (1, 0)}
    # After every batch the counts are those of each job's last state so far.
    first = {(r.type, r.status): r.jobs for r in job_streams.queue_status(spark, str(tmp_path / "out"), 1).collect()}
    assert first == {("scrape_reviews", "completed"): 1, ("scrape_reviews", "failed"): 1, ("export_data", "active"): 1}


def test_repeated_status_batch_counts_once(spark, tmp_path):
    jobs = tmp_path / "jobs"
    land_jobs(spark, jobs, ("a", "waiting", 1))
    job_status(spark, tmp_path)
    land_jobs(spark, jobs, ("a", "active", 2), ("b", "waiting", 1))
    told = job_status(spark, tmp_path)
    # As if the last batch had been lost before it was committed: it runs again over what it wrote.
    for folder in ("commits",):
        for name in ("1", ".1.crc"):
            (tmp_path / "c" / folder / name).unlink()
    assert job_status(spark, tmp_path) == told == {("scrape_reviews", "active"): 1, ("scrape_reviews", "waiting"): 1}


def test_random_job_streams_equal_the_last_states(spark, tmp_path):
    import random

    from echolens.operators.jobs import queue_stats

    rng, seen = random.Random(4), []
    for n in range(4):
        rows = [(f"j{rng.randrange(12)}", rng.choice(S.JOB_STATES), rng.randrange(24)) for _ in range(15)]
        seen += rows
        land_jobs(spark, tmp_path / "jobs", *rows)
        told = job_status(spark, tmp_path)
        course = ["waiting", "delayed", "active", "failed", "completed"]
        last = {}
        for i, status, hour in seen:
            last[i] = max(last.get(i, (-1, -1)), (hour, course.index(status)))
        final = spark.createDataFrame([(i, "scrape_reviews", course[k]) for i, (_, k) in last.items()], "id string, type string, status string")
        stats = queue_stats(final).where("type = 'scrape_reviews'").first()
        assert told == {("scrape_reviews", s): stats[s] for s in S.JOB_STATES if stats[s]}


def test_unanswered_reviews_are_asked_again(spark, tmp_path):
    class Shy:
        """A labeler that leaves out a review the first two times, and answers for another one nobody asked about."""

        def __call__(self, prompt, batch):
            answers = [{"reviewId": i, "theme": "T"} for i, text in batch if not text.startswith("shy")]
            return json.dumps(answers + [{"reviewId": "a", "theme": "Again"} for i, _ in batch if i == "b"])

    landed, root = tmp_path / "landed", str(tmp_path / "tables")

    def run(name, *reviews):
        land(landed, name, name, 0, *reviews)
        streams.stream_ingest(spark, str(landed), root, str(tmp_path / "c1"), DRAIN, DAY1).awaitTermination()
        streams.stream_label(spark, root, str(tmp_path / "c2"), S.DEFAULT_TAXONOMY, Shy(), trigger=DRAIN, as_of=DAY1, attempts=2).awaitTermination()
        state = streams.Versions(spark, f"{root}/{streams.LABEL_STATE}")
        waiting = {r.id: r.tries for r in state.read("unanswered", streams.UNANSWERED).collect()}
        return {r.review_id: r.theme for r in streams.current_labels(spark, root).collect()}, waiting

    assert run("1", ("a", "u", 5, "x"), ("s", "u", 5, "shy one")) == ({"a": "T"}, {"s": 1})
    # An answer nobody asked for counts where the log has the review; the shy one has had its two chances.
    assert run("2", ("b", "u", 5, "x")) == ({"a": "Again", "b": "T"}, {})
    assert run("3", ("s", "u", 5, "shy no more"), ("d", "u", 5, "x"))[0] == {"a": "Again", "b": "T", "d": "T"}


def test_a_batch_reads_no_log(spark, tmp_path):
    """Pages that passed and reviews that were labeled are out of the state a batch reads."""
    landed, root = tmp_path / "landed", str(tmp_path / "tables")
    landed.mkdir()
    for n in range(1, 6):
        page = {"appId": "x", "appOrd": 0, "sortMethod": "recent", "sortOrd": 0, "country": "us", "countryOrd": 0, "page": n,
                "reviews": [{"id": f"r{n}", "userName": "u", "score": 5, "text": "t", "date": "2024-01-01T00:00:00Z"}]}
        (landed / f"{n}.json").write_text(json.dumps(page))
        streams.stream_ingest(spark, str(landed), root, str(tmp_path / "c1"), DRAIN, DAY1).awaitTermination()
    state = streams.Versions(spark, f"{root}/{streams.PAGE_STATE}")
    assert state.read("waiting", "page int").count() == 0
    frontier = state.read("frontier", streams.FRONTIER).collect()
    assert [(r.reached, r.bad) for r in frontier] == [(5, None)]
    assert streams.current_reviews(spark, root).count() == 5


def test_quarantine(spark, tmp_path):
    source = tmp_path / "jobs"
    data = [("1", "export_data", '{"appId":"a"}'), ("2", "export_data", "{}"), ("3", "nope", "{}")]
    spark.createDataFrame(data, "id string, type string, payload string").write.json(str(source))
    stream = spark.readStream.schema("id string, type string, payload string").json(str(source))
    job_streams.stream_quarantine(stream, str(tmp_path / "out"), str(tmp_path / "c"), DRAIN).awaitTermination()
    accepted = spark.read.parquet(str(tmp_path / "out" / "accepted")).collect()
    assert [r.id for r in accepted] == ["1"] and '"includeLabels":true' in accepted[0].payload
    letters = {r.original_job_id: r.failure_reason for r in spark.read.parquet(str(tmp_path / "out" / "dead_letters")).collect()}
    assert letters == {"2": "appId: required", "3": "type: unknown"}
