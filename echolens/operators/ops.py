"""Health rollup and log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Members removed from logs, and the share of debug rows kept by default.
SENSITIVE_KEYS = ("password", "token", "secret", "key", "auth", "authorization")
DEFAULT_RATE = 0.1
_BUCKETS = 10_000


def health_rollup(checks: DataFrame) -> DataFrame:
    """Overall status per service from its check results (service, name, status, critical, timed_out).

    Only a critical check can make a service unhealthy; a check that timed out is unhealthy.
    """
    status = F.when(F.coalesce("timed_out", F.lit(False)), "unhealthy").otherwise(F.col("status"))
    rank = F.when(F.col("critical") & (status == "unhealthy"), 2).when(status == "degraded", 1).otherwise(0)
    return (
        checks.groupBy("service")
        .agg(F.max(rank).alias("_rank"), F.count("*").alias("check_count"))
        .select(
            "service",
            F.when(F.col("_rank") == 2, "unhealthy").when(F.col("_rank") == 1, "degraded").otherwise("healthy").alias("status"),
            "check_count",
        )
    )


def redact_logs(logs: DataFrame, keys: Sequence[str] = SENSITIVE_KEYS, columns: Sequence[str] = ("metadata",)) -> DataFrame:
    """Remove sensitive members from the map columns; nested values are left alone."""
    hidden = list(keys)
    return logs.withColumns({name: F.map_filter(name, lambda k, v: ~k.isin(*hidden)) for name in columns})


def sample_debug_logs(logs: DataFrame, rate: float = DEFAULT_RATE, id_col: str = "id") -> DataFrame:
    """Keep a share of the debug rows and all others. The id's digest decides, so a rerun keeps the same rows.

    A debug row without an id goes.
    """
    digest = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    kept = F.coalesce(F.pmod(digest, F.lit(_BUCKETS)) < int((rate or DEFAULT_RATE) * _BUCKETS), F.lit(False))
    return logs.where((F.col("level") != "debug") | kept)
