from __future__ import annotations

import random

from pyspark.sql import functions as F

from echolens.operators import crawl
from echolens.operators.normalize import normalize_apps, normalize_reviews, to_model_columns
from echolens.plans.collect import app_order, collect_reviews, reviews_to_store
from echolens.sources.readers import read_review_pages

PAGES = "app_id string, country_code string, sort_method string, page int, n_reviews int, error string"


def stopped(spark, pages):
    frame = spark.createDataFrame(pages, PAGES)
    return sorted((r.app_id, r.country_code, r.page) for r in crawl.apply_early_stop(frame).collect())


def test_early_stop_cases(spark):
    cases = {
        "empty": ([(1, 2, None), (2, 0, None), (3, 1, None)], [1]),
        "error": ([(1, 2, None), (2, 0, "boom"), (3, 1, None)], [1]),
        "first": ([(1, 0, "boom"), (2, 5, None)], []),
        "all": ([(1, 1, None), (2, 1, None), (3, 1, None)], [1, 2, 3]),
        "gap": ([(1, 1, None), (3, 1, None)], [1]),
        "no_first": ([(2, 1, None)], []),
        "ten": ([(p, 1, None) for p in range(1, 13)], list(range(1, 13))),
        "twice": ([(1, 1, None), (1, 0, None), (2, 1, None)], []),
    }
    data = [(name, "us", "recent", *page) for name, (pages, _) in cases.items() for page in pages]
    data += [("first", "gb", "recent", 1, 4, None)]
    expected = [(name, "us", page) for name, (_, kept) in cases.items() for page in kept] + [("first", "gb", 1)]
    assert stopped(spark, data) == sorted(expected)


def test_early_stop_brute_force(spark):
    rng = random.Random(7)
    data = [
        (f"a{a}", "us", "recent", page, rng.choice([0, 1, 5, 9]), rng.choice([None] * 9 + ["boom"]))
        for a in range(60)
        for page in rng.sample(range(1, 11), rng.randint(1, 10))
    ]
    expected = []
    for app in {row[0] for row in data}:
        pages = {row[3]: row for row in data if row[0] == app}
        page = 1
        while page in pages and pages[page][4] > 0 and pages[page][5] is None:
            expected.append((app, "us", page))
            page += 1
    assert stopped(spark, data) == sorted(expected)


def test_dedup_last_write_wins(spark):
    data = [
        ("x", "a", 0, 0, 1, 0, 5), ("x", "a", 0, 1, 1, 0, 4), ("x", "a", 1, 0, 1, 0, 3), ("x", "b", 0, 0, 1, 1, 2),
        ("y", "a", 0, 0, 1, 0, 1),
    ]
    raw = spark.createDataFrame(data, "app_id string, id string, sort_ord int, country_ord int, page int, pos int, score int")
    got = {(r.app_id, r.id): (r.score, r.first_seen_sort_ord, r.first_seen_country_ord) for r in crawl.dedup_reviews(raw).collect()}
    assert got == {("x", "a"): (3, 0, 0), ("x", "b"): (2, 0, 0), ("y", "a"): (1, 0, 0)}


def test_dedup_with_one_dominant_review(spark):
    """A third of the rows are copies of one review; the others are checked against a plain dictionary."""
    raw = spark.range(30_000, numPartitions=7).select(
        F.lit("x").alias("app_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 5000).cast("string"))).alias("id"),
        F.lit(0).alias("sort_ord"),
        (F.xxhash64("id") % 5).cast("int").alias("country_ord"),
        F.lit(1).alias("page"),
        F.col("id").alias("pos"),
    )
    best = {}
    for r in raw.collect():
        best[r.id] = max(best.get(r.id, ()), (r.country_ord, r.pos))
    got = {r.id: (r.country_ord, r.pos) for r in crawl.dedup_reviews(raw).collect()}
    assert got == best


def test_plan_order_and_limits(spark, rows):
    apps = spark.createDataFrame([("a",)], "app_id string")
    jobs = crawl.crawl_jobs(apps, ["us", "gb"], 12, ["recent", "helpful"])
    plan = rows(crawl.crawl_plan(jobs), "sort_ord", "country_ord", "page")
    assert len(plan) == 40 and plan[0]["sort_method"] == "recent" and plan[0]["country_code"] == "us"
    assert [p["page"] for p in plan[:10]] == list(range(1, 11)) and plan[10]["country_code"] == "gb"
    job = rows(crawl.crawl_jobs(apps))[0]
    assert (job["countries"], job["pages"], job["sort_methods"], job["throttle_ms"]) == (["us"], 5, ["recent"], 500)
    assert (job["priority"], job["retry_attempts"], job["delay"], job["correlation_id"]) == (5, 3, 0, None)


def test_normalize_reviews(spark, rows):
    schema = "id string, user_name string, user_url string, version string, score int, title string, text string, url string, date string, reply_date string, reply_text string, helpful_votes int, country string, country_code string"
    data = [
        ("a", None, "", "", 5, None, "", "", "2024-01-02T03:04:05-07:00", "", "", None, "zz", "gb"),
        ("b", "u", "http://u", "2", 1, "t", "x", "http://x", "nonsense", "2024-01-02T00:00:00Z", "r", 3, None, "us"),
    ]
    first, second = rows(normalize_reviews(spark.createDataFrame(data, schema)), "id")
    assert (first["user_name"], first["user_url"], first["version"], first["title"], first["text"], first["url"]) == (
        "Anonymous", None, "Unknown", "", "", None,
    )
    assert (first["country"], first["helpful_votes"], first["reply_date"], first["reply_text"]) == ("GB", 0, None, None)
    assert str(first["date"]) == "2024-01-02 10:04:05" and second["date"] is None
    assert (second["user_name"], second["helpful_votes"], str(second["reply_date"])) == ("u", 3, "2024-01-02 00:00:00")
    model = to_model_columns(normalize_reviews(spark.createDataFrame(data, schema)))
    assert model.columns == [
        "id", "userName", "userUrl", "version", "score", "title", "text", "url", "date", "replyDate", "replyText",
        "helpfulVotes", "country",
    ]


def test_normalize_apps(spark, rows):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    fetched = spark.createDataFrame(
        [("a", "T", "", "1", None, "Finance"), ("b", "", "d", None, "dev", "")],
        "id string, title string, description string, version string, developer string, genre string",
    )
    got = [tuple(r.values()) for r in rows(normalize_apps(wanted, fetched), "id")]
    assert got == [
        ("a", "T", None, "1", None, "Finance"), ("b", "Unknown App", "d", None, "dev", None),
        ("c", "Unknown App", None, None, None, None),
    ]


def test_collect_from_landed_json(spark, tmp_path, rows):
    page = '{"appId":"%s","appOrd":%d,"sortMethod":"recent","sortOrd":0,"country":"us","countryOrd":0,"page":%d,"reviews":[%s],"error":%s}'
    review = '{"id":"%s","userName":"%s","score":%d,"date":"2024-01-01T00:00:00Z","text":"t"}'
    lines = [
        page % ("x", 0, 1, review % ("a", "u1", 5) + "," + review % ("bad", "u", 9), "null"),
        page % ("x", 0, 2, "", "null"),
        page % ("x", 0, 3, review % ("late", "u", 1), "null"),
        page % ("y", 1, 1, review % ("a", "u2", 3), "null"),
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    pages = read_review_pages(spark, str(tmp_path))
    collected = collect_reviews(pages)
    stored = rows(reviews_to_store(collected.accepted))
    assert [(r["id"], r["app_id"], r["user_name"], r["score"]) for r in stored] == [("a", "x", "u1", 3)]
    assert [(r["id"], r["errors"]) for r in rows(collected.quarantined)] == [("bad", ["score: range"])]


def test_app_order(spark, rows):
    jobs = spark.createDataFrame([("a", 5), ("b", 1), ("a", 2)], "app_id string, job_ord int")
    assert {r["app_id"]: r["app_ord"] for r in rows(app_order(jobs))} == {"a": 2, "b": 1}


def test_store_order_brute_force(spark):
    """Against a replay of the reference's order: app after app, each first deduplicated, then stored row by row."""
    rng = random.Random(11)
    data = [
        (f"app{a}", a, f"r{rng.randint(0, 40)}", rng.randint(0, 1), rng.randint(0, 2), 1, n, f"user{n}", n % 5 + 1, f"t{n}")
        for n, a in enumerate(rng.choices(range(5), k=900))
    ]
    expected: dict[str, tuple] = {}
    for app in range(5):
        found = {}
        for row in sorted((r for r in data if r[1] == app), key=lambda r: r[3:7]):
            found[row[2]] = row
        for row in found.values():
            first = expected.get(row[2], (row[0], row[7]))
            expected[row[2]] = (first[0], first[1], row[8], row[9])
    schema = "app_id string, app_ord bigint, id string, sort_ord int, country_ord int, page int, pos int, user_name string, score int, text string"
    frame = spark.createDataFrame(data, schema).repartition(5)
    frame = frame.withColumns({"title": F.lit("t"), "helpful_votes": F.lit(0), "country": F.lit("US")})
    got = {r.id: (r.app_id, r.user_name, r.score, r.text) for r in reviews_to_store(frame).collect()}
    assert got == expected


def test_frontier_equals_early_stop_over_all_pages(spark):
    """After each batch what was due so far is what the whole log gives, but for pages taken before a bad copy landed."""
    import random

    from echolens.session import null_safe_join

    schema = "app_id string, country_code string, sort_method string, page int, n_reviews int, error string, no int"
    rng = random.Random(11)
    frontier = spark.createDataFrame([], "app_id string, country_code string, sort_method string, reached long, bad long")
    waiting, log, done, number = spark.createDataFrame([], schema), [], set(), 0
    for _ in range(6):
        batch = []
        for _ in range(rng.randrange(1, 25)):
            bad = rng.random() < 0.06
            batch.append((rng.choice("ab"), rng.choice(["us", None]), "recent", rng.choice([None, 0, *range(1, 9)]),
                          0 if bad and rng.random() < 0.5 else 2, "timeout" if bad else None, number))
            number += 1
        arrived = spark.createDataFrame(batch, schema)
        moved = spark.createDataFrame(crawl.advance_frontier(frontier, waiting, arrived).collect(), frontier.schema)
        due, ahead = crawl.split_due(waiting.unionByName(arrived), moved)
        got, ahead = {r.no for r in due.collect()}, spark.createDataFrame(ahead.collect(), schema)
        before = {r.no for r in crawl.apply_early_stop(spark.createDataFrame(log, schema)).collect()}
        log += batch
        now = {r.no for r in crawl.apply_early_stop(spark.createDataFrame(log, schema)).collect()}
        assert got == now - before
        known = null_safe_join(frontier, moved.withColumnsRenamed({"reached": "_r", "bad": "_b"}), crawl.LIST_KEY)
        assert known.where("_r < reached OR _b > bad").count() == 0 and known.count() == frontier.count()
        frontier, waiting = moved, ahead
