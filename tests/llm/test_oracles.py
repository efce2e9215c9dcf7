"""The queries of the training-data operators against their SQL on the smallest data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from echolens.llm.queries import ORACLES, QUERIES
from tools.check_oracles import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) == ""
