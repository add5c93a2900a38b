"""Versioned snapshots: immutable Parquet folders and one manifest that names the current one.

A version is written whole, checked, then published by renaming its manifest
into place; of two publishers of one version one wins. Readers hold a version,
so what they see never changes. Everything goes through Hadoop's file system.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import paths
from canopy.operators import overlay
from canopy.operators.stats import table_digest
from canopy.sources.validate import repeated, violations
from canopy.sources.work import tidy

SCHEMA_VERSION = 2


@dataclass(frozen=True)
class Manifest:
    version: int
    snapshot_id: str
    generation: int
    cursor: int
    metadata_cursor: int
    record_count: int
    digest: int
    schema: str
    schema_version: int = SCHEMA_VERSION


class StoreError(RuntimeError):
    pass


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, tail: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}".rstrip("/"))

    def _write(self, tail: str, text: str) -> None:
        """Publish a small file: written aside, then renamed to a name that must be free."""
        aside = self._path(f"_tmp-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._path(tail).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path(tail), kinds)
        except Exception as e:
            self._fs.delete(aside, False)
            raise StoreError(f"{tail} is there already") from e

    def _read(self, tail: str) -> dict:
        text = self.spark.read.text(f"{self.root}/{tail}", wholetext=True).first()[0]
        return json.loads(text)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder))

    def manifest(self, version: int | None = None) -> Manifest | None:
        found = self.versions()
        if not found:
            return None
        raw = self._read(f"manifests/{found[-1] if version is None else version}.json")
        if raw.get("schema_version") != SCHEMA_VERSION:
            raise StoreError("another format: the snapshot must be built again")
        return Manifest(**raw)

    def publish(self, entries: DataFrame, cursor: int, metadata_cursor: int | None = None, generation: int | None = None) -> Manifest:
        """Write ``entries`` as the next version, check what was written, and make it current."""
        last = self.manifest()
        snapshot = uuid.uuid4().hex
        with tidy(self.spark):
            entries.write.option("compression", "zstd").parquet(f"{self.root}/data/{snapshot}")
            back = self.spark.read.schema(entries.schema).parquet(f"{self.root}/data/{snapshot}")
            bad = broken(back).limit(3).collect()
        if bad:
            self._fs.delete(self._path(f"data/{snapshot}"), True)
            raise StoreError(f"invalid entries: {bad}")
        row = table_digest(back).first()
        m = Manifest(last.version + 1 if last else 1, snapshot, generation if generation is not None else (last.generation + 1 if last else 1), cursor, cursor if metadata_cursor is None else metadata_cursor, row.rows, row.digest, back.schema.json())
        self._write(f"manifests/{m.version}.json", json.dumps(asdict(m), sort_keys=True))
        return m

    def checkpoint(self, cursor: int, metadata_cursor: int) -> Manifest:
        """Move the cursors alone; the data stays."""
        last = self.manifest()
        if last is None:
            raise StoreError("nothing is published")
        m = Manifest(**{**asdict(last), "version": last.version + 1, "cursor": cursor, "metadata_cursor": metadata_cursor})
        self._write(f"manifests/{m.version}.json", json.dumps(asdict(m), sort_keys=True))
        return m

    def load(self, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest()
        if m is None:
            raise StoreError("nothing is published")
        return self.spark.read.schema(T.StructType.fromJson(json.loads(m.schema))).parquet(f"{self.root}/data/{m.snapshot_id}")

    def verify(self, m: Manifest | None = None) -> bool:
        m = m or self.manifest()
        row = table_digest(self.load(m)).first()
        return m is not None and (row.rows, row.digest) == (m.record_count, m.digest)

    def start_mode(self) -> str:
        """cold, warm, format_migration or rebuild_fallback."""
        try:
            if self.manifest() is None:
                return "cold"
            return "warm" if self.verify() else "rebuild_fallback"
        except StoreError:
            return "format_migration"
        except Exception:
            return "rebuild_fallback"

    def compact(self, tombstones: DataFrame, delta: DataFrame, cursor: int) -> Manifest:
        return self.publish(overlay.merged(self.load(), tombstones, delta), cursor)

    def copy_to(self, other: SnapshotStore) -> Manifest:
        """Copy the current version to another place and check it there; the old copy stays."""
        m = self.manifest()
        got = other.publish(self.load(m), m.cursor, m.metadata_cursor, m.generation)
        if (got.record_count, got.digest) != (m.record_count, m.digest):
            raise StoreError("the copy differs")
        return got

    def clean(self) -> int:
        """Delete data that no manifest names, and files left aside; the number deleted."""
        named = {self._read(f"manifests/{v}.json")["snapshot_id"] for v in self.versions()}
        gone = 0
        for folder, keep in (("data", lambda n: n in named), ("", lambda n: not n.startswith("_tmp-"))):
            if self._fs.exists(self._path(folder)):
                for s in self._fs.listStatus(self._path(folder)):
                    if not keep(s.getPath().getName()):
                        gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def broken(entries: DataFrame) -> DataFrame:
    """Entries that break a rule; a sound table gives none. All rules hold where rows have their names and folded names."""
    if {"parent", "name", "folded"} <= set(entries.columns):
        # A table may hold part of a tree: missing ancestors are the loader's to add.
        return violations(entries, whole=False)
    path = F.col("path")
    alone = entries.where(~paths.normalize(path).eqNullSafe(path) | F.col("kind").isNull() | ~F.col("kind").isin("file", "directory", "symlink", "other")).select("volume", "path", F.lit("malformed").alias("why"))
    return alone.unionByName(repeated(entries).withColumn("why", F.lit("twice")))
