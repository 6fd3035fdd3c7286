"""Atomic publishing of tables (S-05, S-09).

A published base folder holds immutable data folders and numbered manifests::

    <base>/data/<version>-<id>/<table>/   written once, through Spark's commit protocol
    <base>/versions/<version>.claim       taken before anything is written
    <base>/versions/<version>.json        the manifest: the pointer that readers resolve

A manifest names the folder of every table, so several tables (the brief and its
risks) switch together, at the moment the manifest appears. A reader resolves
the newest manifest once and keeps reading these folders, whatever is published
meanwhile; a writer that dies leaves the old version current. Tables that a
version does not write are carried over from the one before.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldpulse.sources.files import Files


class VersionConflict(RuntimeError):
    """Somebody else published in between."""


@dataclass(frozen=True)
class Manifest:
    """One published version, resolved."""

    base: str
    version: int
    published_at: float
    tables: dict[str, str]
    schemas: dict[str, str]
    #: What was observed while the tables of this version were written: {table: {metric: value}}.
    metrics: dict[str, dict]
    #: What the version was made from (export names, source versions); compared by those who ask whether it is stale.
    sources: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.schemas[table]))
        return spark.read.schema(schema).parquet(os.path.join(self.base, self.tables[table]))


class Versions:
    """The versions of the tables under one base folder on shared storage."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.files = Files(spark)
        self._folder = os.path.join(base, "versions")

    def _numbers(self, ending: str) -> list[int]:
        return [int(n[:-len(ending)]) for n in self.files.names(self._folder) if n.endswith(ending)]

    def at(self, version: int) -> Manifest:
        return Manifest(base=self.base, **json.loads(self.files.read(os.path.join(self._folder, f"{version:012d}.json"))))

    def current(self) -> Manifest | None:
        """The newest published version (a folder listing and one small file), or None."""
        done = self._numbers(".json")
        return self.at(max(done)) if done else None

    def publish(self, tables: dict[str, DataFrame], sources: dict | None = None, metrics: dict[str, list] | None = None,
                expect: int | None = None, carry: bool = True) -> Manifest:
        """Write ``tables`` as a new version and make it current.

        ``metrics`` may name aggregates for a table that are observed while it is
        written (next to ``rows``), so nothing is read twice to count it. With
        ``expect`` the version number that was current when the tables were
        planned, publishing fails if another one is current by then.
        """
        before = self.current()
        if expect is not None and expect != (before.version if before else 0):
            raise VersionConflict(f"version {before.version if before else 0} is current, not {expect}")
        version = max([0, *self._numbers(".json"), *self._numbers(".claim")]) + 1
        if not self.files.claim(os.path.join(self._folder, f"{version:012d}.claim")):
            raise VersionConflict(f"version {version} is being published by somebody else")
        folder = os.path.join("data", f"{version:012d}-{uuid.uuid4().hex[:12]}")
        keep = before if carry else None
        paths, schemas, seen = (dict(x) for x in ((keep.tables, keep.schemas, keep.metrics) if keep else ({}, {}, {})))
        for name, df in tables.items():
            watch = Observation()
            observed = df.observe(watch, F.count(F.lit(1)).alias("rows"), *(metrics or {}).get(name, []))
            observed.write.parquet(os.path.join(self.base, folder, name))
            paths[name], schemas[name], seen[name] = os.path.join(folder, name), df.schema.json(), dict(watch.get)
        newest = self._numbers(".json")
        if expect is not None and max([0, *newest]) != expect:
            raise VersionConflict(f"version {max(newest)} was published meanwhile")
        text = json.dumps({"version": version, "published_at": time.time(), "tables": paths, "schemas": schemas, "metrics": seen, "sources": sources or {}})
        self.files.put(os.path.join(self._folder, f"{version:012d}.json"), text)
        return self.at(version)

    def retain(self, keep: int = 2, grace_seconds: float = 3600.0) -> list[int]:
        """Drop versions older than the newest ``keep``, if they were superseded ``grace_seconds`` ago, and folders that no version names.

        Readers of a dropped version have that long to finish. Folders of claims
        that are newer than the newest version may still be written and stay.
        """
        numbers = sorted(self._numbers(".json"))
        if not numbers:
            return []
        manifests = {n: self.at(n) for n in numbers}
        dropped = [n for n, after in zip(numbers, numbers[1:]) if n not in numbers[-keep:] and manifests[after].published_at <= time.time() - grace_seconds]
        for n in dropped:
            self.files.delete(os.path.join(self._folder, f"{n:012d}.json"))
        used = {p.split(os.sep)[1] for n, m in manifests.items() if n not in dropped for p in m.tables.values()}
        data = os.path.join(self.base, "data")
        for name in self.files.names(data):
            number = int(name.split("-")[0])
            if name not in used and number < numbers[-1] and (number in dropped or number not in manifests):
                self.files.delete(os.path.join(data, name))
        return dropped
