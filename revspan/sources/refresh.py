"""Versioned refreshes: readers see all tables and metrics of one refresh, or all of another.

A refresh writes every table into a folder of its own and then, last, a manifest: one JSON document
in one file. What has no manifest does not exist for readers, so a refresh that fails or is
cut off between two tables leaves the version before it in place, and nobody ever reads tables of
two refreshes together. Plain folders; nothing but Spark's own readers and writers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from revspan.sources.files import remove
from revspan.sources.schemas import TABLES
from revspan.sources.tables import _if_present, load_table

Derive = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]

_MANIFEST = (
    "version long, id string, written_at timestamp, "
    "entries array<struct<name: string, kind: string, n_rows: long>>"
)


@dataclass(frozen=True)
class Warehouse:
    """Source tables and metrics below ``root``, a folder that all executors reach.

    One process refreshes at a time. Readers need no lock: what they have opened stays until
    ``expire`` removes its version.
    """

    spark: SparkSession
    root: str

    def manifests(self) -> DataFrame | None:
        """One row per version; None before the first refresh."""
        return _if_present(
            lambda: self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifests/*", mode="FAILFAST"))

    def _all(self) -> list[Row]:
        manifests = self.manifests()
        return [] if manifests is None else manifests.orderBy("version", "id").collect()

    def versions(self) -> list[int]:
        return [row.version for row in self._all()]

    def refresh(self, sources: dict[str, str], derive: Derive | None = None) -> int:
        """Load the CSV at each source's path and derive metrics from what was loaded; the new version.

        sources: name of a declared table -> path. derive: tables -> metrics by name."""
        version, made = max(self.versions(), default=0) + 1, uuid.uuid4().hex
        folder, entries = f"{self.root}/versions/{made}", []
        tables = {}
        for name, path in sources.items():
            tables[name] = load_table(self.spark, path, TABLES[name], f"{folder}/{name}")
            entries.append((name, "table", tables[name].count()))
        for name, metric in (derive(tables) if derive else {}).items():
            seen = Observation()
            metric.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{folder}/{name}")
            entries.append((name, "metric", seen.get["n_rows"]))
        manifest = self.spark.createDataFrame([(version, made, None, entries)], _MANIFEST)
        manifest.withColumn("written_at", F.current_timestamp()).coalesce(1).write.json(f"{self.root}/manifests/{made}")
        return version

    def open(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables and metrics of one version, the newest by default, by name."""
        known = [row for row in self._all() if version in (None, row.version)]
        if not known:
            raise LookupError(f"no version {version or ''} in {self.root}")
        chosen = known[-1]
        return {e.name: self.spark.read.parquet(f"{self.root}/versions/{chosen.id}/{e.name}") for e in chosen.entries}

    def expire(self, keep: int = 2) -> list[int]:
        """Remove all but the newest versions, manifests first, and give their numbers."""
        if keep < 1:
            raise ValueError("at least one version is kept")
        old = self._all()[:-keep]
        for row in old:
            remove(self.spark, f"{self.root}/manifests/{row.id}")
            remove(self.spark, f"{self.root}/versions/{row.id}")
        return [row.version for row in old]
