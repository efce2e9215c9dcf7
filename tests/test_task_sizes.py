"""What one task reads or holds does not grow with the table."""

from __future__ import annotations

import json
from pathlib import Path

import duckdb
import pyarrow as pa

from echolens import schemas as S
from echolens.functions.offline import KeywordLabeler
from echolens.operators import labeling
from tools.check_oracles import compare
from workload import queries
from workload.oracles import ORACLES


def test_large_csv_is_written_by_all_tasks(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_scratch", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = queries.reviews_csv_large(spark, sf).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(tmp_path, "csv-large").glob("part-*.csv"))) > 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert compare(rows, con.execute(ORACLES["reviews_csv_large"]).df()) == ""


class _Task:
    """One task: the batches it gets, and the function that makes its output, run here."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *names):
        return self

    def mapInPandas(self, run, schema):
        return [(len(f), sum(map(len, f["content"])), [i for ids in f["review_ids"] for i in ids]) for f in run(b.to_pandas() for b in self.batches)]

    def mapInArrow(self, run, schema):
        frames = run(iter(self.batches))
        return [(b.num_rows, sum(map(len, b.column("content").to_pylist())), [i for ids in b.column("review_ids").to_pylist() for i in ids]) for b in frames]


def test_labeling_passes_answers_on_in_pieces():
    n = 6_500
    rows = pa.record_batch({"id": [f"r{i}" for i in range(n)], "text": ["great " * 200] * n})
    made = labeling.call_labeler(_Task([rows.slice(0, 6_010), rows.slice(6_010)]), S.DEFAULT_TAXONOMY, KeywordLabeler(), 20)
    assert sum(count for count, _, _ in made) == n // 20
    assert [i for _, _, ids in made for i in ids] == [f"r{i}" for i in range(n)]
    one = len(json.dumps([KeywordLabeler().label("r0000", "great " * 200)])) * 21
    assert max(size for _, size, _ in made) <= (1 << 20) + one
