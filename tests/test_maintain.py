"""Versioned tables: what a run changes appears together, only touched parts move, and insights follow the labels."""

from __future__ import annotations

import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echolens import schemas as S
from echolens.operators import insights, merge, normalize
from echolens.plans import maintain, retry
from echolens.sources.versions import PART, Run, Versions

DAYS = [datetime(2024, 1, day) for day in range(1, 6)]
REVIEW = "id string, app_id string, score int, title string, text string, helpful_votes int, country string"
LABEL = (
    "review_id string, theme string, sentiment string, severity int, feature_request boolean, direct_quote string, "
    "confidence double, model_version string"
)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def reviews(spark, ids, score):
    return spark.createDataFrame([(i, f"a{score}", score, f"t{score}", f"x{i}", score, "US") for i in ids], REVIEW)


def versions_on_disk(root, table):
    return {
        (int(p.parent.name.split("=")[1]), int(p.name.split("=")[1])) for p in Path(root, "data", table).glob("version=*/part=*")
    }


def test_upserts_touch_few_parts(spark, tmp_path):
    tables = Versions(spark, str(tmp_path))
    ids = [f"r{i}" for i in range(400)] + [None, None]
    assert len(maintain.put_reviews(tables, reviews(spark, ids, 1), DAYS[0], parts=64)) == 64
    whole = maintain.current(tables, "reviews")
    wanted = merge.upsert_reviews(whole, reviews(spark, ids[:7] + ["new1", "new2", None], 4), DAYS[1])
    wanted = rows_of(wanted)
    touched = maintain.put_reviews(tables, reviews(spark, ids[:7] + ["new1", "new2", None], 4), DAYS[1], parts=64)
    assert len(touched) <= 10
    assert rows_of(maintain.current(tables, "reviews")) == wanted
    # The second run wrote the touched parts and nothing else, and read them from their old places.
    assert {part for version, part in versions_on_disk(tmp_path, "reviews") if version == 1} == set(touched)
    read = tables.begin().read("reviews", S.REVIEWS, touched[:2])
    assert {f"part={p}" for p in touched[:2]} == {Path(f).parent.name for f in read.inputFiles()}


def test_nothing_appears_before_the_manifest(spark, tmp_path, monkeypatch):
    tables = Versions(spark, str(tmp_path))
    maintain.put_reviews(tables, reviews(spark, ["a", "b"], 1), DAYS[0], parts=8)
    before = rows_of(maintain.current(tables, "reviews"))

    def lost(self):
        raise RuntimeError("lost between stage and publish")

    with monkeypatch.context() as patch:
        patch.setattr(Run, "publish", lost)
        with pytest.raises(RuntimeError):
            maintain.put_reviews(tables, reviews(spark, ["a", "c", "d"], 2), DAYS[1], parts=8)
    assert rows_of(maintain.current(tables, "reviews")) == before
    maintain.put_reviews(tables, reviews(spark, ["a", "e"], 3), DAYS[2], parts=8)
    assert [r[0] for r in rows_of(maintain.current(tables, "reviews"))] == ["a", "b", "e"]


def test_versions(spark, tmp_path):
    tables = Versions(spark, str(tmp_path))
    assert tables.latest() is None and tables.read("t", "x int").collect() == []
    first, second = tables.begin(), tables.begin()
    frame = spark.createDataFrame([(x, x % 3) for x in range(9)], f"x int, {PART} int")
    first.put("t", frame)
    first.append("log", frame.select("x").limit(1))
    first.publish()
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        second.publish()
    run = tables.begin()
    run.put("t", frame.where("x > 100"), [1])
    with pytest.raises(ValueError):
        run.put("t", frame, [0])
    run = tables.begin()
    run.put("t", frame.where("x > 100"), [1])
    run.append("log", frame.select("x").limit(2))
    run.publish()
    assert sorted(r.x for r in tables.read("t", "x int").collect()) == [0, 2, 3, 5, 6, 8]
    assert tables.read("log", "x int").count() == 3 and tables.read("log", "x int", version=0).count() == 1
    assert tables.latest(below=1) == 0


def test_insights_follow_relabels(spark, tmp_path):
    tables, rng = Versions(spark, str(tmp_path)), random.Random(2)

    def batch(ids):
        return spark.createDataFrame(
            [(i, rng.choice(["x", "y", "z", None]), rng.choice(S.SENTIMENTS), rng.choice([1, 3, 5, None]), rng.random() < 0.4, "q", 0.5, "m") for i in ids],
            LABEL,
        )

    ids = [f"r{i}" for i in range(120)]
    for day, chosen in zip(DAYS, (ids[:50], ids[40:], rng.sample(ids, 30), rng.sample(ids, 60))):
        maintain.put_labels(tables, batch(chosen).persist(), day, parts=16)
        labels = maintain.current(tables, "labels").withColumn("ord", F.unix_micros("created_at"))
        scratch = insights.insight_stats(normalize.analyses_from_columns(normalize.labels_to_analyses(labels)))
        names = scratch.columns
        assert rows_of(maintain.maintained_stats(tables).select(names)) == rows_of(scratch.select(names))
        assert maintain.current(tables, "labels").count() == len({r.review_id for r in labels.collect()})
    counted = [n for n in names if not n.startswith("first_")]
    changes = maintain.insight_changes(tables).groupBy("theme").agg(*[F.sum(n).alias(n) for n in counted[1:]])
    assert rows_of(changes.select(counted)) == rows_of(scratch.select(counted))


def test_labels_and_csv_appear_together(spark, tmp_path, monkeypatch):
    tables = Versions(spark, str(tmp_path))
    stored = spark.createDataFrame([(i, "a", 3, "t", 'a "b"\nc', 1, "US") for i in ("r1", "r2", "r3")], REVIEW)
    for name in S.REVIEWS.fieldNames():
        if name not in stored.columns:
            stored = stored.withColumn(name, F.lit(None).cast(S.REVIEWS[name].dataType))
    label = spark.createDataFrame([("r1", "x", "positive", 1, True, "q", 0.5, "m")], LABEL)
    with monkeypatch.context() as patch:
        patch.setattr(Run, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            maintain.put_labels(tables, label, DAYS[0], parts=4, reviews=stored)
    assert maintain.labeled_csv(tables).count() == 0 and maintain.current(tables, "labels").count() == 0
    maintain.put_labels(tables, label, DAYS[0], parts=4, reviews=stored)
    second = spark.createDataFrame([("r3", "y", "negative", 2, False, "q", 0.5, "m")], LABEL)
    maintain.put_labels(tables, second, DAYS[1], parts=4, reviews=stored)
    found = maintain.labeled_csv(tables).collect()
    assert sorted((r["Review ID"], r["Review Text"], r["theme"]) for r in found) == [("r1", 'a "b"\nc', "x"), ("r3", 'a "b"\nc', "y")]


def letters(spark, n):
    found = [(f"dlq_{i}", json.dumps({"n": i}), str(i), "label_reviews", "Rate limit" if i % 2 else "Other", DAYS[i % 5]) for i in range(n)]
    frame = spark.createDataFrame(
        found, "id string, original_job_data string, original_job_id string, original_job_type string, failure_reason string, failed_at timestamp"
    )
    missing = [f for f in S.DEAD_LETTERS.fields if f.name not in frame.columns]
    return frame.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def test_retry_is_one_step(spark, tmp_path, monkeypatch):
    tables = Versions(spark, str(tmp_path))
    retry.put_dead_letters(tables, letters(spark, 40), parts=8)

    def state():
        return sorted(r.id for r in retry.retried(tables).collect()), {r.id for r in retry.dead_letters(tables).collect()}

    everything = {f"dlq_{i}" for i in range(40)}
    with monkeypatch.context() as patch:
        patch.setattr(Run, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        for call in (lambda: retry.retry_letters(tables, ["dlq_3"], parts=8), lambda: retry.retry_reason(tables, "label_reviews", "Rate limit", 4, parts=8)):
            with pytest.raises(RuntimeError):
                call()
    assert state() == ([], everything)
    retry.retry_letters(tables, ["dlq_3", "dlq_8"], parts=8)
    assert state() == (["retry_3", "retry_8"], everything - {"dlq_3", "dlq_8"})
    assert len({p for v, p in versions_on_disk(tmp_path, "dead_letters") if v == 1}) <= 2
    with pytest.raises(LookupError):
        retry.retry_letters(tables, ["dlq_3"], parts=8)
    retry.retry_reason(tables, "label_reviews", "Rate limit", 4, parts=8)
    made, rest = state()
    assert made == ["retry_19", "retry_29", "retry_3", "retry_39", "retry_8", "retry_9"]
    assert rest == everything - {f"dlq_{m.removeprefix('retry_')}" for m in made}
