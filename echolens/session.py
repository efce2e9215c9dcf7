"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs several milliseconds per Column on the driver; plans here hold hundreds of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # A repeated key in a JSON object takes its last value, as the reference's JSON reader does.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app_name: str = "echolens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests, may fall back to
    a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="echolens-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that several consumers read it instead of recomputing it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: columns can be pruned, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where NULL equals NULL. The keys of ``right`` do not appear in the result."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = reduce(and_, [left[key].eqNullSafe(renamed[f"_right_{key}"]) for key in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{key}" for key in keys])
