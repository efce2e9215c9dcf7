"""Properties of the physical plans that the scale of the data depends on."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from echolens.operators import backlog, crawl, deadletter, insights, jobs, merge
from echolens.sources import readers, writers
from workload import inputs as T
from workload.queries import _analyses


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    writers.write_table(T.stored_reviews(spark, sf), root, "reviews")
    writers.write_table(T.stored_labels(spark, sf), root, "labels")
    return readers.read_table(spark, root, "reviews"), readers.read_table(spark, root, "labels")


def test_theme_stats_combine_before_the_shuffle(spark, sf):
    text = plan(insights.insight_stats(_analyses(spark, sf)))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text and text.count("Exchange") == 1


def test_dedup_combines_before_the_shuffle(spark, sf):
    text = plan(crawl.dedup_reviews(T.raw_reviews(spark, sf)))
    assert "partial_max_by" in text and text.count("Exchange") == 1 and "Window" not in text


def test_early_stop_does_not_shuffle_contents(spark, sf):
    text = plan(crawl.apply_early_stop(T.landed_pages(spark, sf)))
    masks = [line for line in text.splitlines() if "partial_min" in line]
    assert masks and not re.search(r"\breviews\b", masks[0]) and "Window" not in text


def test_top_k_per_group_is_limited_before_the_shuffle(spark, sf):
    for frame in (
        jobs.recent_jobs(T.job_table(spark, sf)),
        jobs.keep_last_finished(T.job_table(spark, sf)),
        jobs.clean_queue(T.job_table(spark, sf), T.AS_OF)[0],
        deadletter.dead_letter_page(T.dead_letters(spark, sf)),
    ):
        text = plan(frame)
        assert re.search(r"WindowGroupLimit.*Partial", text)


def test_backlog_reads_texts_only_for_the_picked(stored):
    text = plan(backlog.unlabeled_reviews(*stored, 10))
    assert "TakeOrderedAndProject" in text
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert sum("user_name" in schema for schema in schemas) == 1  # the wide scan, behind a broadcast of the ids
    assert "LeftSemi, BuildRight" in text
    assert "struct<id:string,created_at:timestamp>" in schemas and "struct<review_id:string>" in schemas


def test_quotes_are_a_distributed_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(insights.feature_request_quotes(_analyses(spark, sf)))


def test_export_filters_reach_the_scan(stored):
    text = plan(writers.export_reviews(*stored, "src3", end=T.AS_OF).select("id", "theme"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(app_id,src3\)", text) and "LessThanOrEqual(date" in text
    assert "text:string" not in text


def test_small_upsert_does_not_shuffle_the_target(stored):
    reviews, _ = stored
    source = reviews.limit(5).drop("created_at", "updated_at")
    reviews.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan(merge.upsert_reviews(reviews, source, T.AS_OF, source_rows=5))
        large = plan(merge.upsert_reviews(reviews, source, T.AS_OF))
    finally:
        reviews.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in small and small.count("BroadcastHashJoin") >= 3
    assert "FullOuter" in large


def test_positions_use_a_range_shuffle(spark, sf):
    frame = backlog.number_batches(T.job_table(spark, sf).select("id", "type"), [F.asc("id")], by=["type"])
    text = plan(frame)
    assert "Scan parquet" in text and not re.search(r"row_number", text)


def test_no_cross_joins(spark, sf, stored):
    reviews, labels = stored
    stats = insights.insight_stats(_analyses(spark, sf))
    themes, totals = insights.theme_insights(stats), insights.insight_totals(stats)
    frames = [
        insights.swot(themes, insights.overall_sentiment(stats), insights.feature_requests(stats), totals),
        jobs.queue_health(T.job_table(spark, sf), T.dead_letters(spark, sf)),
        deadletter.dlq_overview(T.dead_letters(spark, sf)),
        backlog.enrich_reviews(reviews, labels),
        merge.upsert_labels(labels, labels.drop("id", "created_at", "updated_at"), T.AS_OF),
    ]
    for frame in frames:
        assert "CartesianProduct" not in plan(frame) and "NestedLoop" not in plan(frame)


def test_bucketed_tables_join_without_a_shuffle(stored, tmp_path):
    reviews, labels = stored
    spark = reviews.sparkSession
    writers.write_bucketed(reviews, "reviews_in_buckets", "id", 4, str(tmp_path / "reviews"))
    writers.write_bucketed(labels, "labels_in_buckets", "review_id", 4, str(tmp_path / "labels"))
    left, right = spark.table("reviews_in_buckets"), spark.table("labels_in_buckets")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (
            backlog.enrich_reviews(left, right),
            backlog.unlabeled_reviews(left, right, None),
            merge.orphans(right, left, "review_id", "id"),
        ):
            assert "SortMergeJoin" in plan(frame) and "Exchange" not in plan(frame)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_answers_do_not_shuffle_the_reviews(spark, tmp_path):
    """Answers go out to the review table; with broadcasts only on request, no exchange by key is left."""
    from echolens.operators.labeling import split_unmatched

    spark.range(5000).selectExpr("concat('r', id) AS id").write.parquet(f"{tmp_path}/reviews")
    spark.range(10).selectExpr("concat('r', id * 900) AS review_id").write.parquet(f"{tmp_path}/answers")
    reviews, answers = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("reviews", "answers"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched, unmatched = split_unmatched(answers, reviews, 10)
        for side in (matched, unmatched):
            text = plan(side)
            assert "SortMergeJoin" not in text and "hashpartitioning(id" not in text
        assert matched.count() == 6 and unmatched.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
