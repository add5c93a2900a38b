"""Search over many volumes, each with an index of its own: fan-out, merge, partial failure, mounts and labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.search import Request, first_by_place, matches, gated, sort_keys

STATES = ("opening", "queued", "scanning", "base_ready", "catching_up", "live", "rebuilding", "paused", "offline", "storage_offline", "storage_read_only", "storage_low_space", "migrating", "failed")
FRESHNESS = {"live": "live", "paused": "paused_stale", "catching_up": "catching_up", "rebuilding": "rebuilding"}
LABELS = {s: s.replace("_", " ").capitalize() for s in STATES} | {"paused": "Paused, results may be old", "offline": "Source volume offline", "storage_offline": "Index storage offline"}
#: Volumes that never are sources of files: a fixed list of the platform's.
HIDDEN = ("Preboot", "Recovery", "VM", "Update")


@dataclass(frozen=True)
class Volume:
    uuid: str
    display: str
    mount: str
    is_system: bool = False
    state: str = "live"
    metadata_ready: bool = True

    @property
    def searchable(self) -> bool:
        return self.state in ("base_ready", "catching_up", "live", "rebuilding", "paused")

    @property
    def freshness(self) -> str:
        return FRESHNESS.get(self.state, "base_snapshot")


@dataclass
class Found:
    hits: list
    has_more: bool
    searched: int
    catching_up: int
    offline: int
    failed: dict[str, str] = field(default_factory=dict)
    metadata_complete: bool = True


class Federation:
    """Volumes and, for each, how to get its live rows (volume, path, name, folded, kind, size, mtime)."""

    def __init__(self):
        self.volumes: dict[str, Volume] = {}
        self._rows: dict[str, Callable[[], DataFrame]] = {}
        self.selected: set[str] = set()

    def mount(self, volume: Volume, rows: Callable[[], DataFrame]) -> None:
        """Add a volume, or bring one back: its rows are those of its index as it is now."""
        self.volumes[volume.uuid], self._rows[volume.uuid] = volume, rows
        self.selected.add(volume.uuid)

    def refresh(self, mounted: set[str]) -> None:
        """Volumes that aren't mounted any more are offline; those that are back catch up."""
        for u, v in self.volumes.items():
            if u not in mounted:
                self.volumes[u] = replace(v, state="offline")
            elif v.state == "offline":
                self.volumes[u] = replace(v, state="catching_up")

    def select(self, uuids: set[str]) -> set[str]:
        """The volumes to search; system volumes are always among them."""
        self.selected = {u for u, v in self.volumes.items() if u in uuids or v.is_system}
        return self.selected

    def search(self, r: Request) -> Found:
        """The merged first hits; a volume whose index fails gives no hits and is named, the others answer.

        Each volume gives one row more than asked, so what is beyond the page is
        known; one path on two volumes is two hits.
        """
        chosen = [v for u, v in self.volumes.items() if u in self.selected]
        live = [v for v in chosen if v.searchable]
        failed: dict[str, str] = {}
        hits: list = []
        more = Request(r.query, r.limit + 1 if r.limit > 0 else 0, r.sort, r.descending)
        if r.query and r.limit > 0:
            for v in live:
                try:
                    rows = self._rows[v.uuid]().withColumn("volume", F.lit(v.uuid)).withColumn("display", F.lit(v.display))
                    hits += volume_hits(rows, more).collect()  # at most limit + 1 rows
                except Exception as e:
                    failed[v.uuid] = str(e).splitlines()[0][:200]
        top = merged_hits(hits, more)
        return Found(
            top[: max(0, r.limit)],
            len(top) > max(0, r.limit),
            len(live) - len(failed),
            sum(v.state == "catching_up" for v in chosen),
            sum(v.state == "offline" for v in chosen),
            failed,
            all(v.metadata_ready for v in live if v.uuid not in failed),
        )


def volume_hits(rows: DataFrame, r: Request) -> DataFrame:
    """One volume's first hits, a path once."""
    return first_by_place(gated(matches(rows, r.query)), r).orderBy(*sort_keys(r, True)).limit(max(0, r.limit))


def merged_hits(hits: list, r: Request) -> list:
    """The first of all volumes' hits: at most limit + 1 rows a volume, put in order on the driver."""
    rest = lambda h: (h.match_rank, h.folded.encode(), h.path.encode(), h.display.encode(), h.volume.encode())
    out = sorted(hits, key=rest)
    if r.sort == "name":
        out.sort(key=lambda h: rest(h)[2:])
        out.sort(key=lambda h: (h.folded.encode(), h.name.encode()), reverse=r.desc)
    elif r.sort != "relevance":
        known = sorted((h for h in out if h[r.sort] is not None), key=lambda h: h[r.sort], reverse=r.desc)
        out = known + [h for h in out if h[r.sort] is None]
    return out[: max(0, r.limit)]


def fan_out(rows: DataFrame, r: Request) -> DataFrame:
    """The same in one plan, over ``rows`` with ``display``: each volume's first limit + 1, then the first of all."""
    from pyspark.sql import Window

    w = Window.partitionBy("volume").orderBy(*sort_keys(r, True))
    per = gated(matches(rows, r.query)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= r.limit + 1).drop("_n")
    return per.orderBy(*sort_keys(r, True)).limit(r.limit)


def included(mount: Column, is_local: Column, file_system: Column) -> Column:
    """Whether a mounted volume is a source: local, no network file system, the root or a visible direct child of ``/Volumes``."""
    name = F.substring_index(mount, "/", -1)
    child = mount.rlike("^/Volumes/[^/]+$") & ~name.isin(*HIDDEN) & ~name.startswith(".")
    return is_local & ~file_system.isin("autofs", "smbfs", "nfs") & ((mount == "/") | child)


def sources(mounts: DataFrame) -> DataFrame:
    """``mounts(uuid, display, mount, is_local, file_system)`` that are sources: one row a volume, the system's first, then by name."""
    from pyspark.sql import Window

    some = mounts.where(included(F.col("mount"), F.col("is_local"), F.col("file_system"))).withColumn("is_system", F.col("mount") == "/")
    first = Window.partitionBy("uuid").orderBy(F.col("is_system").desc(), "mount")
    one = some.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return one.orderBy(F.col("is_system").desc(), "display", "uuid")


def label(state: Column) -> Column:
    """A state's text."""
    out = F.lit(None).cast("string")
    for s, text in LABELS.items():
        out = F.when(state == s, text).otherwise(out)
    return out


def freshness(state: Column) -> Column:
    """What a volume's results are worth, by its state."""
    out = F.lit("base_snapshot")
    for s, f in FRESHNESS.items():
        out = F.when(state == s, f).otherwise(out)
    return out
