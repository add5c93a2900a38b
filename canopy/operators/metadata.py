"""Sizes and times as a table of their own, bound to the base that it belongs to."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.stats import table_digest
from canopy.sources.store import Manifest, SnapshotStore, StoreError

KEY = ["volume", "path"]
META = "volume string, path string, size long, mtime long"


@dataclass(frozen=True)
class MetadataManifest:
    version: int
    table_id: str
    base_id: str
    generation: int
    cursor: int
    record_count: int
    digest: int


def bound(m: MetadataManifest | None, base: Manifest | None) -> bool:
    """Whether the table may be read with that base: it names it, and has its generation and number of rows."""
    return m is not None and base is not None and (m.base_id, m.generation, m.record_count) == (base.snapshot_id, base.generation, base.record_count)


class MetadataStore:
    """Versions of the table beside the base's; a table is current only with the base that it names."""

    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark

    def _names(self) -> list[int]:
        folder = self.store._path("metadata")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self.store._fs.listStatus(folder)) if self.store._fs.exists(folder) else []

    def manifest(self) -> MetadataManifest | None:
        found = self._names()
        return MetadataManifest(**self.store._read(f"metadata/{found[-1]}.json")) if found else None

    def publish(self, base: Manifest, rows: DataFrame, cursor: int) -> MetadataManifest:
        """Write ``rows(volume, path, size, mtime)``, a row per entry of the base; unknown values are null."""
        table = uuid.uuid4().hex
        rows.select(*KEY, "size", "mtime").write.parquet(f"{self.store.root}/values/{table}")
        back = self.spark.read.schema(META).parquet(f"{self.store.root}/values/{table}")
        bad = invalid(back, self.store.load(base)).limit(3).collect()
        if bad:
            raise StoreError(f"metadata doesn't fit its base: {bad}")
        row = table_digest(back).first()
        last = self.manifest()
        m = MetadataManifest(last.version + 1 if last else 1, table, base.snapshot_id, base.generation, cursor, row.rows, row.digest)
        self.store._write(f"metadata/{m.version}.json", json.dumps(asdict(m), sort_keys=True))
        return m

    def checkpoint(self, cursor: int) -> MetadataManifest:
        """Move the cursor alone."""
        last = self.manifest()
        if last is None:
            raise StoreError("no metadata is published")
        m = replace(last, version=last.version + 1, cursor=cursor)
        self.store._write(f"metadata/{m.version}.json", json.dumps(asdict(m), sort_keys=True))
        return m

    def load(self) -> DataFrame | None:
        """The table if it belongs to the current base, else none: then sizes and times are unknown."""
        m = self.manifest()
        return self.spark.read.schema(META).parquet(f"{self.store.root}/values/{m.table_id}") if bound(m, self.store.manifest()) else None

    def start_cursor(self) -> int:
        """Where the stream begins: at the lesser of the two cursors; without a table, at the base's."""
        m, base = self.manifest(), self.store.manifest()
        return min(m.cursor, base.cursor) if bound(m, base) else (base.cursor if base else 0)


def invalid(metadata: DataFrame, base: DataFrame) -> DataFrame:
    """Rows that break a rule: no entry, no row for an entry, two rows, a size on what isn't a file, a negative size."""
    pair = base.select(*KEY, "kind").join(metadata.withColumn("_m", F.lit(True)), KEY, "full")
    why = F.when((F.col("kind") != "file") & F.col("size").isNotNull() & F.col("_m").isNotNull(), F.concat(F.lit("size_of_"), "kind")).otherwise(
        F.when(F.col("kind").isNull(), "no_entry").when(F.col("_m").isNull(), "no_row").when(F.col("size") < 0, "negative")
    )
    twice = metadata.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit("twice").alias("why"))
    return pair.select(*KEY, why.alias("why")).where("why IS NOT NULL").unionByName(twice)


def aligned(scanned: DataFrame, base: DataFrame) -> DataFrame:
    """The first values of a base: each entry with what a scan of the same path, kind and file id saw, else unknown."""
    a, b = scanned.alias("s"), base.alias("b")
    same = [F.col("s.volume") == F.col("b.volume"), F.col("s.path") == F.col("b.path"), F.col("s.kind") == F.col("b.kind"), F.col("s.file_id").eqNullSafe(F.col("b.file_id"))]
    size = F.when(F.col("b.kind") == "file", F.col("s.size"))
    return b.join(a, same, "left").select("b.volume", "b.path", size.alias("size"), F.col("s.mtime").alias("mtime"))


def unaligned(scanned: DataFrame, base: DataFrame) -> DataFrame:
    """Scanned rows that no entry matches: they belong to the overlay."""
    same = [scanned[c] == base[c] for c in ("volume", "path", "kind")] + [scanned["file_id"].eqNullSafe(base["file_id"])]
    return scanned.join(base, same, "left_anti")


def bootstrap_cursor(fence: int, base_cursor: int, overlay_rows: int) -> int:
    """The first cursor: the fence before the scan; no later than the base's while part of the overlay isn't stored."""
    return min(fence, base_cursor) if overlay_rows else fence


def unknown_sizes(metadata: DataFrame, base: DataFrame) -> DataFrame:
    """One row: entries, and files whose size isn't known."""
    rows = base.select(*KEY, "kind").join(metadata, KEY, "left")
    return rows.agg(F.count("*").alias("entries"), F.count_if((F.col("kind") == "file") & F.col("size").isNull()).alias("unknown_sizes"))


def updated(values: DataFrame, updates: DataFrame) -> DataFrame:
    """``values`` after ``updates(volume, path, seq, size, mtime, gone)``: the last update of a path counts, and a gone path's values are unknown.

    Paths that have no row get one, unless they are gone.
    """
    last = updates.groupBy(*KEY).agg(F.max_by(F.struct("size", "mtime", "gone"), "seq").alias("u"))
    both = values.select(*KEY, F.struct("size", "mtime").alias("v")).join(last, KEY, "full")
    now = F.when(F.col("u").isNull(), F.col("v")).when(~F.col("u.gone"), F.struct("u.size", "u.mtime"))
    return both.where("v IS NOT NULL OR NOT u.gone").select(*KEY, now["size"].alias("size"), now["mtime"].alias("mtime"))


def changed_rows(values: DataFrame, updates: DataFrame) -> DataFrame:
    """The rows that ``updated`` changes: equal values are no change."""
    new = updated(values, updates)
    there = [new["volume"] == values["volume"], new["path"] == values["path"], new["size"].eqNullSafe(values["size"]), new["mtime"].eqNullSafe(values["mtime"])]
    return new.join(values, there, "left_anti")


@dataclass(frozen=True)
class CheckpointRule:
    rows: int = 100_000
    bytes: int = 32 * 2**20
    quiet: float = 30
    interval: float = 600
    safety: int = 256 * 2**20


def checkpoint_due(stats: DataFrame, rule: CheckpointRule = CheckpointRule()) -> DataFrame:
    """Adds ``due`` to rows of overlay_rows, overlay_bytes, quiet_seconds, since_seconds: enough to store, quiet and not too soon, or past the safety bound."""
    enough = (F.col("overlay_rows") >= rule.rows) | (F.col("overlay_bytes") >= rule.bytes)
    calm = (F.col("quiet_seconds") >= rule.quiet) & (F.col("since_seconds") >= rule.interval)
    return stats.withColumn("due", (enough & calm) | (F.col("overlay_bytes") >= rule.safety))


@dataclass(frozen=True)
class MetadataState:
    """Whether sizes and times may be used, as the table is bound, built, replayed, paused or lost."""

    cursor: int = 0
    floor: int = 0
    has_table: bool = False
    history_done: bool = False
    paused: bool = False
    failed: bool = False
    building: bool = False
    pending: bool = False

    @property
    def freshness(self) -> str:
        if self.failed:
            return "failed"
        if self.paused:
            return "paused_stale"
        if not self.has_table:
            return "building" if self.building else "unavailable"
        return "live" if self.history_done and not self.pending else "catching_up"

    def bind(self, has_table: bool, cursor: int) -> MetadataState:
        return MetadataState(cursor, cursor, has_table, building=not has_table, paused=self.paused)

    def begin(self, fence: int) -> MetadataState:
        return replace(self, building=True, floor=fence, cursor=self.cursor if self.has_table else fence)

    def install(self) -> MetadataState:
        return replace(self, has_table=True, building=False, failed=False)

    def advance(self, event_id: int, history_done: bool = False, pending: bool = False) -> MetadataState:
        top = 2**63 - 1
        return replace(self, cursor=max(self.cursor, event_id) if event_id < top else self.cursor, history_done=self.history_done or history_done, pending=pending)

    def pause(self, on: bool) -> MetadataState:
        return replace(self, paused=on, history_done=self.history_done and on)

    def fail(self) -> MetadataState:
        return replace(self, has_table=False, failed=True)


#: Renames of a directory that may follow each other before its rows are rewritten.
ALIAS_DEPTH, ALIAS_COUNT = 16, 64


def chained_source(rows: DataFrame, aliases: DataFrame, depth: int = ALIAS_DEPTH) -> DataFrame:
    """``rows(volume, path)`` with ``source``, the path in the base after ``aliases(volume, new_root, old_root)`` are followed, longest root first, up to ``depth`` times.

    Aliases are few (``ALIAS_COUNT`` a volume), so they are broadcast.
    """
    from canopy.functions import paths

    out = rows.select(*KEY).distinct().withColumn("source", F.col("path"))
    named = F.broadcast(aliases.select("volume", "new_root", "old_root").limit(ALIAS_COUNT * 1024))
    if aliases.limit(ALIAS_COUNT * 1024 + 1).count() > ALIAS_COUNT * 1024:
        raise ValueError("too many renames: write the rows under their new paths")
    for _ in range(min(depth, aliases.groupBy("volume").count().agg(F.max("count")).first()[0] or 0)):
        up = out.select(*KEY, "source", F.explode(paths.ancestors(F.col("source"), proper=False)).alias("new_root")).join(named, ["volume", "new_root"])
        best = up.groupBy(*KEY).agg(F.max_by(F.struct("new_root", "old_root"), F.length("new_root")).alias("a"))
        moved = F.concat("a.old_root", F.expr("substring(source, length(a.new_root) + 1)"))
        out = out.join(best, KEY, "left").select(*KEY, F.when(F.col("a").isNull(), F.col("source")).otherwise(moved).alias("source"))
    return out
