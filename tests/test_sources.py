from __future__ import annotations

import json
from datetime import datetime

import pytest

from echolens import schemas as S
from echolens.sources import readers, writers

TEXTS = ['a "quoted" one, with comma', "two\nlines", "  outer blanks  ", "", "back\\slash\\", "tab\tand 'x'", "ümläut \U0001f600"]


def reviews(spark):
    base = dict.fromkeys(S.REVIEWS.fieldNames())
    data = [
        tuple((base | {"id": f"r{i}", "app_id": "a" if i % 2 else "b", "text": t, "score": 3, "country": "US", "date": datetime(2024, 1, 1 + i)}).values())
        for i, t in enumerate(TEXTS)
    ]
    return spark.createDataFrame(data, S.REVIEWS)


def labels(spark):
    base = dict.fromkeys(S.LABELS.fieldNames())
    data = [tuple((base | {"id": "L", "review_id": "r1", "theme": "T", "sentiment": "neutral", "severity": 2, "feature_request": True, "direct_quote": "q"}).values())]
    return spark.createDataFrame(data, S.LABELS)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    assert writers.write_reviews_csv(reviews(spark), path) is True
    back = readers.read_reviews_csv(spark, path)
    assert back.columns == ["id", "Country", "User Name", "User URL", "App Version", "Rating", "Review Title", "text", "Review URL", "Review Date", "Developer Reply Date", "Developer Reply Text", "Helpful Votes"]
    got = {r.id: (r.text, r["User URL"], r["Review Date"]) for r in back.collect()}
    # CSV has no way to tell an empty text from a missing one; both are read as NULL.
    assert got == {f"r{i}": (t or None, None, f"2024-01-{1 + i:02d}T00:00:00.000Z") for i, t in enumerate(TEXTS)}


def test_no_rows_no_file(spark, tmp_path):
    assert writers.write_reviews_csv(reviews(spark).where("false"), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()


def test_csv_with_other_headers(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Key,Body,Stars\n1,"x, ""y""",5\n')
    row = readers.read_reviews_csv(spark, str(tmp_path / "in.csv"), "Key", "Body").first()
    assert (row.id, row.text, row.Stars) == ("1", 'x, "y"', "5")


def test_labeled_output(spark):
    out = writers.labeled_reviews(reviews(spark), labels(spark))
    assert out.columns[-5:] == ["theme", "sentiment", "severity", "feature_request", "direct_quote"]
    assert out.where("`Review ID` = 'r1'").first().theme == "T" and out.count() == len(TEXTS)


def test_export(spark):
    frame = reviews(spark)
    assert sorted(r.id for r in writers.export_reviews(frame, labels(spark), "a").collect()) == ["r1", "r3", "r5"]
    bounded = writers.export_reviews(frame, labels(spark), "a", False, datetime(2024, 1, 4), datetime(2024, 1, 6))
    assert sorted(r.id for r in bounded.collect()) == ["r3", "r5"] and "theme" not in bounded.columns


def test_result_formats(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1)], "x string, y int")
    for fmt, reader in (("csv", spark.read.option("header", True).csv), ("json", spark.read.json), ("database", spark.read.parquet)):
        writers.write_result(frame, str(tmp_path / fmt), fmt)
        assert reader(str(tmp_path / fmt)).first().x == "a"
    with pytest.raises(ValueError, match="xml"):
        writers.write_result(frame, str(tmp_path / "x"), "xml")


def test_tables(spark, tmp_path):
    writers.write_table(reviews(spark), str(tmp_path), "reviews")
    assert readers.read_table(spark, str(tmp_path), "reviews").schema == S.REVIEWS
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.write_table(reviews(spark), str(tmp_path), "reviews")


def test_taxonomy(spark, tmp_path):
    own = [{"name": "Bug", "description": "d"}, {"name": "Idea", "sample_quotes": ["q"]}]
    good, broken = tmp_path / "t.json", tmp_path / "b.json"
    good.write_text(json.dumps({"themes": own}, indent=2))
    broken.write_text("{")
    taxonomy = readers.load_taxonomy(spark, str(good))
    rows = readers.taxonomy_table(spark, taxonomy).orderBy("ord").collect()
    assert [(r.name, r.description, r.sample_quotes) for r in rows] == [("Bug", "d", None), ("Idea", None, ["q"])]
    assert readers.taxonomy_themes(own) == own
    for path in (str(broken), str(tmp_path / "missing.json"), None):
        assert len(readers.load_taxonomy(spark, path)["themes"]) == 9


def test_analyses_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ord":1,"analysis":{"theme":"A"}}\n{"ord":0}\n')
    got = {r.ord: r.theme for r in readers.read_analyses(spark, str(tmp_path), lines=True).selectExpr("ord", "try_variant_get(record, '$.analysis.theme', 'string') AS theme").collect()}
    assert got == {0: None, 1: "A"}


def test_large_csv_equals_the_reader_of_whole_files(spark, tmp_path):
    import random

    rng = random.Random(5)
    odd = ["plain", 'a "quoted" word', "two\nlines", "comma, here", '"', '""', "", " outer ", "\n\n", 'ends"\n', None, "é中", '"\n"', "x" * 400]
    rows = [(f"r{i}", rng.choice(odd), " ".join(str(rng.choice(odd)) for _ in range(rng.randrange(6)))) for i in range(900)]
    frame = spark.createDataFrame(rows, "`Review ID` string, Title string, `Review Text` string")
    path = str(tmp_path / "csv")
    frame.coalesce(2).write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    (tmp_path / "csv" / "part-open.csv").write_text('Review ID,Title,Review Text\nlast,t,"never\nclosed')
    (tmp_path / "csv" / "part-plain.csv").write_text("Review ID,Title,Review Text\n\np1,t,x\n\np2,,y")
    wanted = readers.read_reviews_csv(spark, path)

    def large():
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        found = readers.read_large_reviews_csv(spark, path)
        assert found.columns == wanted.columns
        return sorted(map(str, found.collect()))

    assert in_small_ranges(spark, large) == sorted(map(str, wanted.collect()))


def in_small_ranges(spark, act):
    small = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        return act()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_large_document_equals_the_reader_of_whole_files(spark, tmp_path):
    import random

    rng = random.Random(9)

    def value(depth):
        kinds = [1, -2.5, "plain", 'a "q" \\ } ] , : {', "\\", "é中}", True, None, "x" * 300]
        if depth and rng.random() < 0.6:
            items = [value(depth - 1) for _ in range(rng.randrange(4))]
            return items if rng.random() < 0.4 else {rng.choice(["a", "b}", "analyses", 'k"']): x for x in items}
        return rng.choice(kinds)

    for n in range(6):
        elements = [value(3) for _ in range(rng.randrange(60))]
        members = {"head": value(2), "list": [{"x": 1}, 2], "analyses": elements, "tail": value(2), "more": {"analyses": [1]}}
        if n % 2:
            members = dict(reversed(members.items()))
        folder = tmp_path / f"d{n}"
        folder.mkdir()
        text = json.dumps(members, indent=n % 3 or None, ensure_ascii=n % 2 == 0)
        (folder / "a.json").write_text(text + ("\n" if n % 2 else ""), encoding="utf-8")
        (folder / "b.json").write_text('{"analyses": [ ]}' if n % 2 else '{"analyses":[{"only": 1}], "z": "}"}')

        def read(reader, folder=str(folder)):
            return sorted((r.ord, r.j) for r in reader(spark, folder).selectExpr("ord", "to_json(record) AS j").collect())

        assert in_small_ranges(spark, lambda read=read: read(readers.read_large_analyses)) == read(readers.read_analyses)


@pytest.mark.parametrize(
    "text", ['{"analyses": 5}', '[{"analyses": [1]}]', '{"analyses": [1, {"a": 2}', '{"analyses": [1]', '{"other": []}', '{"analyses": {"a": 1}}', '{"analyses": ["x]}']
)
def test_wrong_large_documents_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="no array member 'analyses'"):
        readers.read_large_analyses(spark, str(tmp_path)).collect()


def test_wrong_elements_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"analyses": [{"a": 1}, {"a" 2}, 3]}')
    with pytest.raises(Exception, match="cannot be read"):
        readers.read_large_analyses(spark, str(tmp_path)).collect()
