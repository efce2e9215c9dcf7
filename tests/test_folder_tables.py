"""Tables that are folders of several files, as larger data comes, are read whole by streams too."""

from __future__ import annotations

import pickle
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark import cloudpickle

from tools.check_oracles import compare
from workload import queries
from workload.oracles import ORACLES

STREAMS = (
    "stream_ingest_raw", "stream_label", "stream_label_unmatched", "stream_dedup", "stream_queue_status", "stream_job_states",
    "stream_queue_activity", "stream_quarantine",
)


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("folders")
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_stream_over_a_folder_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}/*.parquet'")
    assert compare(queries.QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLES[name]).df()) == ""


def test_labelers_of_the_queries_travel_by_value(tmp_path):
    """Executors have neither package installed and another working folder."""
    script = "import pickle, sys; print(pickle.load(sys.stdin.buffer)('', [('r3', 't')]))"
    for labeler, told in ((queries._Ghosts(), b"ghost3"), (queries.LABELER, b"r3")):
        run = subprocess.run(
            [sys.executable, "-I", "-c", script], input=cloudpickle.dumps(labeler, pickle.HIGHEST_PROTOCOL), cwd=tmp_path, capture_output=True
        )
        assert run.returncode == 0, run.stderr
        assert told in run.stdout
