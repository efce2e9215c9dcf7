"""Tables under one root whose changes appear together or not at all.

A table is a set of parts: the buckets of a hash, or one part per run of a table that only grows. A run writes the parts
it changes into a folder of its version and, last, the manifest of that version: one small file that names, for every
part of every table, the version that holds it. Readers follow a manifest, so they see all changes of a run or none, and
a run that was lost before its manifest leaves nothing to see; the next one with its version writes over what it left.
Parts that a run did not change stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that deals the rows of a table into its parts; it names folders and is not stored.
PART = "part"
_ENTRY = "name string, part bigint, version bigint"


def part_of(keys: Sequence[str], parts: int) -> Column:
    """The part of a row among ``parts``, by a hash of its keys. NULL keys have a part like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).alias(PART)


class Versions:
    """The tables under ``root``, as the latest manifest has them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def latest(self, below: int | None = None) -> int | None:
        """The latest version that was published, or the latest one below a bound; None if there is none."""
        try:
            files = self.spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="part-*.parquet")
            found = files.load(f"{self.root}/manifest").select(
                F.regexp_extract("path", r"/version=(\d+)/[^/]*$", 1).cast("bigint").alias("version")
            )
        except AnalysisException:
            return None
        return (found if below is None else found.where(F.col("version") < below)).agg(F.max("version")).first()[0]

    def entries(self, version: int | None) -> dict[str, dict[int, int]]:
        """For each table its parts and the versions that hold them."""
        out: dict[str, dict[int, int]] = {}
        if version is not None:
            rows = self.spark.read.schema(_ENTRY).parquet(f"{self.root}/manifest/version={version}")
            for name, part, held in rows.collect():
                out.setdefault(name, {})[part] = held
        return out

    def read(
        self, name: str, schema: T.StructType | str, version: int | None = None, fmt: str = "parquet", **options: str
    ) -> DataFrame:
        """A table as of a version, by default the latest; empty if that has no such table."""
        entries = self.entries(self.latest() if version is None else version)
        return self._parts(name, schema, entries.get(name, {}).items(), fmt, **options)

    def _parts(self, name: str, schema, parts: Iterable[tuple[int, int]], fmt: str = "parquet", **options: str) -> DataFrame:
        paths = [f"{self.root}/data/{name}/version={version}/{PART}={part}" for part, version in sorted(parts)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(fmt).schema(schema).options(**options).load(paths)

    def begin(self, version: int | None = None) -> Run:
        """A run on top of the latest version, or, with a version of its own as a micro-batch has, of the latest below it."""
        base = self.latest(version)
        return Run(self, (0 if base is None else base + 1) if version is None else version, base, version is not None)


class Run:
    """Changes that ``publish`` makes visible together."""

    def __init__(self, tables: Versions, version: int, base: int | None, again: bool):
        self.tables, self.version, self.again = tables, version, again
        self.known = tables.entries(base)
        self.changed = {name: dict(parts) for name, parts in self.known.items()}

    def read(self, name: str, schema: T.StructType | str, parts: Sequence[int] | None = None) -> DataFrame:
        """A table before this run, or some of its parts; no other part is listed or read."""
        held = self.known.get(name, {})
        wanted = held if parts is None else [p for p in parts if p in held]
        return self.tables._parts(name, schema, ((p, held[p]) for p in wanted))

    def staged(self, name: str, schema: T.StructType | str, parts: Sequence[int] | None = None) -> DataFrame:
        """A table as this run will publish it."""
        held = self.changed.get(name, {})
        wanted = held if parts is None else [p for p in parts if p in held]
        return self.tables._parts(name, schema, ((p, held[p]) for p in wanted))

    def put(
        self, name: str, rows: DataFrame, parts: Sequence[int] | None = None, fmt: str = "parquet", **options: str
    ) -> None:
        """Stage new contents of ``parts``, or of the whole table, from ``rows`` with a column ``part``."""
        path = f"{self.tables.root}/data/{name}/version={self.version}"
        rows.repartition(PART).write.partitionBy(PART).mode("overwrite").format(fmt).options(**options).save(path)
        # Which parts have rows is told by the names of the files, one or a few for each part.
        files = self.tables.spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="part-*")
        found = (re.search(rf"/{PART}=(\d+)/[^/]*$", file) for (file,) in files.load(path).select("path").collect())
        made = sorted({int(at[1]) for at in found if at})
        held = self.changed.setdefault(name, {})
        if parts is not None and not set(made) <= set(parts):
            raise ValueError(f"rows of {name} belong to parts that the run does not rewrite: {sorted(set(made) - set(parts))}")
        for part in list(held) if parts is None else parts:
            held.pop(part, None)
        held.update(dict.fromkeys(made, self.version))

    def append(self, name: str, rows: DataFrame, fmt: str = "parquet", **options: str) -> None:
        """Stage rows that a growing table gets from this run, in a part of their own."""
        path = f"{self.tables.root}/data/{name}/version={self.version}/{PART}={self.version}"
        rows.write.mode("overwrite").format(fmt).options(**options).save(path)
        self.changed.setdefault(name, {})[self.version] = self.version

    def publish(self) -> None:
        """Make the changes visible. Of two runs on one base the second one fails; a repeated batch replaces its own."""
        rows = [(name, part, held) for name, parts in self.changed.items() for part, held in parts.items()]
        manifest = self.tables.spark.createDataFrame(rows, _ENTRY).coalesce(1)
        mode = "overwrite" if self.again else "errorifexists"
        manifest.write.mode(mode).parquet(f"{self.tables.root}/manifest/version={self.version}")
