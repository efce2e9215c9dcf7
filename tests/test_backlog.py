from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.functions.offline import KeywordLabeler
from echolens.operators import backlog, labeling
from echolens.operators.ordinals import first_per_group, with_position
from echolens.plans.label import label_backlog


def test_position_by_group_brute_force(spark):
    """One group has most of the rows, so it must span partitions; ties in the order are broken by id."""
    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else f"g{i % 17}", rng.randint(0, 50)) for i in range(5000)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "id int, g string, v int").repartition(6)
    got = {r.id: r.position for r in with_position(frame, [F.desc("v"), F.asc("id")], ["g"]).collect()}
    groups = defaultdict(list)
    for i, g, v in data:
        groups[g].append((-v, i))
    assert got == {i: n for members in groups.values() for n, (_, i) in enumerate(sorted(members), 1)}
    everything = {r.id: r.position for r in with_position(frame, [F.desc("v"), F.asc("id")]).collect()}
    assert everything == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, _, v in data), 1)}


def test_first_per_group_beyond_the_threshold(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 2).alias("g"))
    few = first_per_group(frame, ["g"], [F.desc("id")], 3)
    assert sorted(r.id for r in few.collect()) == [4994, 4995, 4996, 4997, 4998, 4999]
    many = first_per_group(frame, ["g"], [F.desc("id")], 1500)
    assert sorted(r.id for r in many.collect()) == list(range(2000, 5000))


def test_batches(spark):
    ids = spark.createDataFrame([(f"r{i:02d}", i) for i in range(45)], "id string, ord int").repartition(5)
    batches = backlog.number_batches(ids, [F.asc("ord")])
    assert [r["count"] for r in batches.groupBy("batch_no").count().orderBy("batch_no").collect()] == [20, 20, 5]
    jobs = backlog.label_jobs(batches).orderBy("batch_no").collect()
    assert [len(j.review_ids) for j in jobs] == [20, 20, 5]
    assert jobs[1].review_ids == [f"r{i:02d}" for i in range(20, 40)]
    assert (jobs[0].retry_attempts, jobs[0].priority, jobs[0].correlation_id) == (2, 5, None)


def review_frame(spark, n):
    base = dict.fromkeys(S.REVIEWS.fieldNames())
    records = [
        tuple((base | {"id": f"r{i}", "text": f"text {i}", "score": 3, "country": "US", "created_at": datetime(2024, 1, 1 + i % 5)}).values())
        for i in range(n)
    ]
    return spark.createDataFrame(records, S.REVIEWS)


def label_frame(spark, ids):
    base = dict.fromkeys(S.LABELS.fieldNames())
    return spark.createDataFrame([tuple((base | {"id": f"L{i}", "review_id": i, "theme": "T"}).values()) for i in ids], S.LABELS)


def test_unlabeled_newest_first(spark):
    reviews, labels = review_frame(spark, 20), label_frame(spark, ["r4", "r9"])
    got = [r.id for r in backlog.unlabeled_reviews(reviews, labels, 4).collect()]
    assert got == ["r14", "r19", "r13", "r18"]
    assert backlog.unlabeled_reviews(reviews, labels, None).count() == 18
    some = spark.createDataFrame([("r1",), ("r2",), ("zz",)], "id string")
    assert [r.id for r in backlog.reviews_by_ids(reviews, some).collect()] == ["r2", "r1"]
    assert backlog.skip_done(reviews, labels, "review_id").count() == 18


def test_request_layout(spark):
    frame = spark.createDataFrame([(0, 2, "b", "two"), (0, 1, "a", 'say "one"')], "batch_no int, position int, id string, text string")
    request = labeling.label_requests(frame, S.DEFAULT_TAXONOMY).first()
    assert request.review_ids == ["a", "b"]
    assert request.user_prompt == 'Analyze these app reviews:\n\n1. ID: a\nText: "say "one""\n---\n2. ID: b\nText: "two"\n---'
    assert request.user_prompt == labeling.user_prompt([("a", 'say "one"'), ("b", "two")])
    assert '"name": "Data/Sync"' in request.system_prompt and "General Feedback" in request.system_prompt


def test_a_failed_call_costs_its_batch_only(spark):
    def failing_for_r7(prompt, reviews):
        if any(review_id == "r7" for review_id, _ in reviews):
            raise RuntimeError("no answer")
        return KeywordLabeler()(prompt, reviews)

    reviews = review_frame(spark, 12).coalesce(1).orderBy(F.substring("id", 2, 9).cast("int")).coalesce(1)
    labels = labeling.label_reviews(reviews, S.DEFAULT_TAXONOMY, failing_for_r7, batch_size=5).collect()
    assert len(labels) == 12
    failed = {r.review_id for r in labels if float(r.confidence) == 0}
    assert failed == {"r5", "r6", "r7", "r8", "r9"}


def test_backlog_run(spark):
    reviews, labels = review_frame(spark, 30), label_frame(spark, ["r1"])
    now = datetime(2024, 5, 1)
    run = label_backlog(reviews, labels, S.DEFAULT_TAXONOMY, KeywordLabeler(), now, limit=10, batch_size=3)
    table = run.labels.collect()
    assert len(table) == 11 and {r.updated_at for r in table if r.review_id != "r1"} == {now}
    summary = run.summary.first()
    assert (summary.items_processed, summary.neutral, summary.average_confidence) == (10, 10, 0.6)
    assert run.unmatched.count() == 0
    done = label_backlog(reviews, label_frame(spark, [f"r{i}" for i in range(30)]), S.DEFAULT_TAXONOMY, KeywordLabeler(), now)
    assert done.summary.first().message == "No unlabeled reviews found" and done.labels.count() == 30


def test_unmatched_and_repeated_answers(spark):
    def strangers(prompt, reviews):
        return '[{"reviewId":"zz","theme":"A"},{"reviewId":"r0","theme":"first"},{"reviewId":"r0","theme":"second"}]'

    run = label_backlog(review_frame(spark, 2), label_frame(spark, []), S.DEFAULT_TAXONOMY, strangers, datetime(2024, 5, 1), batch_size=50)
    assert {(r.review_id, r.theme) for r in run.labels.collect()} == {("r0", "second")}
    assert {r.review_id for r in run.unmatched.collect()} == {"zz"}
