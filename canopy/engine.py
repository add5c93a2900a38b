"""One object over many volumes: search, change, verify, checkpoint, compact, recover and close."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.storage import command_json
from canopy.functions.text import with_folded
from canopy.operators import overlay, reconcile, stats
from canopy.operators.metadata import MetadataStore, bound
from canopy.operators.search import Request, resolve_sort, search, search_page
from canopy.sources.store import Manifest, SnapshotStore
from canopy.sources.work import work_table

POLICIES = ("fast", "compact_if_due", "force_compact")


@dataclass(frozen=True)
class Config:
    root: str
    #: Time between micro-batches of the change stream.
    latency_ms: int = 20
    #: Tasks of a directory walk.
    workers: int = 8
    limit: int = 50
    offline: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if not 1 <= self.latency_ms <= 1000:
            raise ValueError("latency_ms must be from 1 to 1000")
        if not 1 <= self.workers <= 16:
            raise ValueError("workers must be from 1 to 16")

    @property
    def trigger(self) -> str:
        return f"{self.latency_ms} milliseconds"


@dataclass(frozen=True)
class Result:
    hits: list
    has_more: bool
    generation: int
    freshness: str
    metadata_complete: bool


class Engine:
    """A published snapshot with an overlay of later changes.

    ``entries`` have volume, path, parent, name, kind, size, mtime, file_id.
    Batches of changes are files beside the snapshot that they change, named in
    order: they outlive the process, and a new snapshot leaves them behind.
    """

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = SnapshotStore(spark, config.root)
        self.metadata = MetadataStore(self.store)
        self._paused: set[str] = set()
        self._held: list[tuple[DataFrame, str | None]] = []
        self._rows: DataFrame | None = None
        self.state = "catching_up" if self.store.versions() else "opening"

    # ------------------------------------------------------------ build

    def load(self, entries: DataFrame, cursor: int = 0) -> Manifest:
        """Fold names once and publish a base; pending changes go."""
        rows = entries if "folded" in entries.columns else with_folded(entries)
        m = self.store.publish(rows, cursor)
        self._rows, self.state = None, "live"
        return m

    def scan(self, volume: str, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
        """The rows of a mounted tree, walked by ``workers`` tasks."""
        from canopy.sources.namespace import scan

        return scan(self.spark, volume, os.path.realpath(os.path.expanduser(root)), excluded, self.config.workers)

    def rebuild(self, entries: DataFrame, cursor: int) -> Manifest:
        return self.load(entries, cursor)

    def recover(self, entries: Callable[[], DataFrame], fence: int, since: Callable[[int], DataFrame] | None = None) -> Manifest:
        """Build the base again after history was lost.

        ``fence`` is an id taken before ``entries`` is read; the old base answers
        meanwhile. What came after the fence (``since(fence)``: mutations) is
        applied to the new base, as the scan may or may not have seen it.
        """
        self.state = "rebuilding"
        later = since(fence) if since else None
        held = work_table(later, "replay") if later is not None else None
        m = self.load(entries(), fence)
        if held is not None:
            self.state = "catching_up"
            self.apply(held)
        self.state = "live"
        return m

    # ------------------------------------------------------------ changes

    def _folder(self) -> str:
        m = self.store.manifest()
        return f"pending/{m.snapshot_id if m else 'none'}"

    def batches(self) -> list[str]:
        """Names of the batches that wait for compaction, in order."""
        folder = self.store._path(self._folder())
        if not self.store._fs.exists(folder):
            return []
        return sorted(str(s.getPath().getName()) for s in self.store._fs.listStatus(folder))

    def apply(self, mutations: DataFrame, name: str | None = None) -> None:
        """Add a batch of (op, seq, entry columns); later batches win. A batch of a name that is there is replaced. While paused, batches are held back."""
        if self._paused:
            self._held.append((mutations, name))
            return
        rows = mutations if "folded" in mutations.columns else with_folded(mutations)
        found = self.batches()
        at = name or f"{len(found):08d}"
        rows.write.mode("overwrite").parquet(f"{self.store.root}/{self._folder()}/{at}")
        self._rows = None

    def _all_rows(self) -> DataFrame:
        if self._rows is None:
            base = self.store.load()
            batch = None
            for i, name in enumerate(self.batches()):
                rows = self.spark.read.parquet(f"{self.store.root}/{self._folder()}/{name}")
                rows = rows.withColumn("seq", F.col("seq").cast("long") + F.lit(i * 2**40)).select("op", "seq", *base.columns)
                batch = rows if batch is None else batch.unionByName(rows)
            self._applied = overlay.apply_mutations(base, batch) if batch is not None else None
            self._rows = self._applied.live if self._applied else base
        return self._rows

    def rows(self) -> DataFrame:
        """The live rows: the base under its pending changes, volumes that are offline left out."""
        rows = self._all_rows()
        return rows.where(~F.col("volume").isin(list(self.config.offline))) if self.config.offline else rows

    def reconcile_parent(self, path: str, listing: DataFrame) -> None:
        """List the folder of a path that turned out to be missing; ``listing`` are the rows that are there now."""
        from canopy.functions import paths

        up = self.spark.createDataFrame([(path,)], "path string").select(paths.parent(F.col("path"))).first()[0]
        volumes = listing.select("volume").distinct()
        scopes = volumes.select("volume", F.lit(up).alias("root"), F.lit(False).alias("subtree"))
        now = self._all_rows()
        self.apply(reconcile.reconcile(now, listing.select(*now.columns), scopes))

    # ------------------------------------------------------------ queries

    def _request(self, r: Request) -> tuple[DataFrame, Request, DataFrame | None, bool]:
        rows = self.rows()
        values = self.metadata.load()
        ready = values is not None or {"size", "mtime"} <= set(rows.columns)
        return rows, Request(r.query, r.limit, resolve_sort(r.sort, ready), r.descending), values, ready

    def search(self, query: str, limit: int | None = None, sort: str = "relevance", descending: bool | None = None) -> Result:
        rows, r, values, ready = self._request(Request(query, self.config.limit if limit is None else limit, sort, descending))
        hits, more = search_page(rows, r, values)
        m = self.store.manifest()
        return Result(hits, more, m.generation + (1 if self.batches() else 0), self.freshness, ready and not self._paused)

    def search_frame(self, r: Request) -> DataFrame:
        rows, r, values, _ = self._request(r)
        return search(rows, r, values)

    @property
    def freshness(self) -> str:
        if self._paused:
            return "paused_stale"
        return {"live": "live", "catching_up": "catching_up", "rebuilding": "rebuilding"}.get(self.state, "base_snapshot")

    def stats(self) -> DataFrame:
        return stats.index_stats(self.rows())

    def diagnostics(self) -> str:
        """One line of JSON: the manifest, the overlay and the state."""
        m, batches = self.store.manifest(), self.batches()
        size = overlay.overlay_size(self._applied.delta).first() if batches and self._all_rows() is not None else None
        out = {k: v for k, v in asdict(m).items() if k != "schema"} if m else {}
        out |= {"batches": len(batches), "held_batches": len(self._held), "state": self.state, "freshness": self.freshness, "paused_by": sorted(self._paused)}
        out |= {"delta_rows": size.rows if size else 0, "delta_bytes": size.bytes if size else 0, "metadata": bound(self.metadata.manifest(), m)}
        return command_json(out)

    def verify(self, actual: DataFrame) -> DataFrame:
        return overlay.verify(actual, self.rows())

    # ------------------------------------------------------------ maintenance

    def checkpoint(self, cursor: int, metadata_cursor: int | None = None) -> Manifest:
        """With changes a compaction, else the cursors alone; the metadata cursor stays where it is unless it is given."""
        last = self.store.manifest()
        values = last.metadata_cursor if metadata_cursor is None else metadata_cursor
        return self.compact(cursor, values) if self.batches() else self.store.checkpoint(cursor, values)

    def compact(self, cursor: int, metadata_cursor: int | None = None) -> Manifest:
        base = self.store.load()
        last = self.store.manifest()
        m = self.store.publish(self._all_rows().select(*base.columns), cursor, last.metadata_cursor if metadata_cursor is None else metadata_cursor)
        self._rows = None
        return m

    def compaction_due(self, quiet_seconds: float) -> bool:
        """Whether the overlay is large, or large beside its base, and quiet."""
        if not self.batches():
            return False
        self._all_rows()
        size = overlay.overlay_size(self._applied.delta).first()
        row = [(size.rows, size.bytes, self._applied.tombstones.count(), self.store.manifest().record_count, float(quiet_seconds))]
        frame = self.spark.createDataFrame(row, "delta_rows long, delta_bytes long, dead_rows long, base_rows long, quiet_seconds double")
        return overlay.compaction_due(frame).first().due

    def maintain(self, cursor: int, quiet_seconds: float) -> Manifest | None:
        """Compact if it is due."""
        return self.compact(cursor) if self.compaction_due(quiet_seconds) else None

    def close(self, policy: str = "fast", cursor: int = 0) -> None:
        """``fast`` leaves pending batches for the next start; the others compact, if it is due or in any case."""
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        if self.batches() and (policy == "force_compact" or (policy == "compact_if_due" and self.compaction_due(1e9))):
            self.compact(max(cursor, self.store.manifest().cursor))
        self.state = "stopped"

    def pause(self, reason: str) -> None:
        """Reasons (user, volume, sleep) are apart: the engine runs when none is left."""
        self._paused.add(reason)

    def resume(self, reason: str) -> bool:
        """Whether the engine runs again; what was held back is then applied in order."""
        self._paused.discard(reason)
        if not self._paused:
            held, self._held = self._held, []
            for rows, name in held:
                self.apply(rows, name)
        return not self._paused

    def command(self, line: str, listing: Callable[[], DataFrame] | None = None) -> str:
        """One line of the text surface: a query, or :stats :verify :rebuild :checkpoint :compact :diagnostics :quit."""
        line = line.strip()
        m = self.store.manifest()
        if line == ":stats":
            return "\n".join(command_json(r.asDict()) for r in self.stats().orderBy("volume").collect())
        if line in (":verify", ":rebuild"):
            if listing is None:
                raise ValueError(f"{line} needs a listing")
            if line == ":rebuild":
                return command_json({"version": self.rebuild(listing(), m.cursor if m else 0).version})
            n = self.verify(listing()).groupBy("class").count().collect()
            return command_json({"missing": 0, "extra": 0} | {r["class"]: r["count"] for r in n})
        if line in (":checkpoint", ":compact"):
            done = self.checkpoint(m.cursor) if line == ":checkpoint" else self.compact(m.cursor)
            return command_json({"version": done.version})
        if line == ":diagnostics":
            return self.diagnostics()
        if line == ":quit":
            self.close()
            return ""
        if line.startswith(":"):
            raise ValueError(f"unknown command {line}")
        return "\n".join(f"{h.volume}:{h.path}" for h in self.search(line).hits)
