from __future__ import annotations

from datetime import datetime

import pytest

from echolens import schemas as S
from echolens.operators import merge

OLD, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def reviews(spark, *records):
    base = dict.fromkeys(S.REVIEWS.fieldNames()) | {"country": "US", "created_at": OLD, "updated_at": OLD}
    return spark.createDataFrame([tuple((base | record).values()) for record in records], S.REVIEWS)


@pytest.mark.parametrize("source_rows", [None, 2])
def test_upsert_reviews(spark, source_rows):
    target = reviews(
        spark, {"id": "a", "app_id": "x", "user_name": "u1", "score": 5, "helpful_votes": 1}, {"id": "c", "score": 2}
    )
    source = reviews(
        spark,
        {"id": "a", "app_id": "y", "user_name": "u2", "score": 3, "helpful_votes": 9},
        {"id": "b", "app_id": "y", "user_name": "u3", "score": 4},
    ).drop("created_at", "updated_at")
    merged = merge.upsert_reviews(target, source, NOW, source_rows)
    assert merged.columns == target.columns
    got = {r.id: (r.app_id, r.user_name, r.score, r.helpful_votes, r.created_at, r.updated_at) for r in merged.collect()}
    assert got == {
        "a": ("x", "u1", 3, 9, OLD, NOW), "b": ("y", "u3", 4, None, NOW, NOW), "c": (None, None, 2, None, OLD, OLD),
    }


@pytest.mark.parametrize("source_rows", [None, 2])
def test_update_to_null_is_kept(spark, source_rows):
    target = reviews(spark, {"id": "a", "title": "old"})
    source = reviews(spark, {"id": "a", "title": None}).drop("created_at", "updated_at")
    assert merge.upsert_reviews(target, source, NOW, source_rows).first().title is None


def labels(spark, *records):
    base = dict.fromkeys(S.LABELS.fieldNames()) | {"created_at": OLD, "updated_at": OLD}
    return spark.createDataFrame([tuple((base | record).values()) for record in records], S.LABELS)


def test_upsert_labels(spark):
    target = labels(spark, {"id": "L1", "review_id": "a", "theme": "T1"})
    source = labels(spark, {"review_id": "a", "theme": "T2"}, {"review_id": "b", "theme": "T3"}).drop("id", "created_at", "updated_at")
    got = {r.review_id: r for r in merge.upsert_labels(target, source, NOW).collect()}
    assert (got["a"].id, got["a"].theme, got["a"].created_at, got["a"].updated_at) == ("L1", "T2", OLD, NOW)
    assert got["b"].theme == "T3" and got["b"].id.startswith("label_") and got["b"].created_at == NOW
    again = {r.review_id: r.id for r in merge.upsert_labels(target, source, NOW).collect()}
    assert again["b"] == got["b"].id


def test_ensure_apps(spark):
    def apps(*records):
        base = dict.fromkeys(S.APPS.fieldNames()) | {"created_at": OLD, "updated_at": OLD}
        return spark.createDataFrame([tuple((base | record).values()) for record in records], S.APPS)

    target = apps({"id": "x", "title": "Unknown App"})
    source = apps({"id": "x", "title": "Real"}, {"id": "y", "title": "New"}).drop("created_at", "updated_at")
    got = {r.id: (r.title, r.created_at) for r in merge.ensure_apps(target, source, NOW).collect()}
    assert got == {"x": ("Unknown App", OLD), "y": ("New", NOW)}


def test_orphans_and_cascade(spark):
    parent = spark.createDataFrame([("p1",), ("p2",)], "id string")
    child = spark.createDataFrame([("c1", "p1"), ("c2", "p3"), ("c3", "p2")], "id string, parent_id string")
    assert [r.id for r in merge.orphans(child, parent, "parent_id", "id").collect()] == ["c2"]
    left = merge.cascade_delete(child, parent.where("id = 'p1'"), "parent_id")
    assert sorted(r.id for r in left.collect()) == ["c2", "c3"]
