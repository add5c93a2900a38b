"""Where a source's index lives: safe folders, names, health, and the catalog of choices."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PATH_MAX = 1024
HEALTH = ("available", "read_only", "low_space", "offline", "identity_changed", "migrating", "failed")


def root_key(relative_root: Column) -> Column:
    """SHA-256 of a source's root within its volume, in hex: the name of its index folder."""
    return F.sha2(relative_root, 256)


def uuid_bytes(uuid: Column) -> Column:
    """The 16 bytes of a UUID's text; null for any other text."""
    hex_ = F.replace(uuid, F.lit("-"), F.lit(""))
    return F.when(uuid.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.unhex(hex_))


def uuid_text(data: Column) -> Column:
    """The upper-case text of 16 bytes; null for any other number of them."""
    h = F.hex(data)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.octet_length(data) == 16, F.concat_ws("-", *parts))


def safe_relative(path: Column) -> Column:
    """Whether a folder's path is relative, in bounds, and without empty, ``.`` or ``..`` parts."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda x: x.isin("", ".", ".."))
    return F.coalesce((path != "") & (F.octet_length(path) < PATH_MAX) & ~F.contains(path, F.lit("\0")) & ~odd, F.lit(False))


def health(mounted: Column, same_identity: Column, read_only: Column, free_bytes: Column, required: Column, migrating: Column) -> Column:
    """The state of an index's storage; the first that holds."""
    return (
        F.when(~mounted, "offline")
        .when(~same_identity, "identity_changed")
        .when(migrating, "migrating")
        .when(read_only, "read_only")
        .when(free_bytes < required, "low_space")
        .otherwise("available")
    )


@dataclass(frozen=True)
class Place:
    """A chosen storage: a volume and a folder in it; none stands for the default place."""

    volume: str | None = None
    folder: str | None = None


class Catalog:
    """Which source's index lives where: one small file per change, the last one counts."""

    def __init__(self, spark: SparkSession, root: str):
        from canopy.sources.store import SnapshotStore

        self._store = SnapshotStore(spark, root)

    def _versions(self) -> list[int]:
        folder = self._store._path("places")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._store._fs.listStatus(folder)) if self._store._fs.exists(folder) else []

    def places(self) -> dict[str, Place]:
        found = self._versions()
        return {k: Place(**v) for k, v in self._store._read(f"places/{found[-1]}.json").items()} if found else {}

    def _put(self, places: dict[str, Place]) -> None:
        found = self._versions()
        text = json.dumps({k: {"volume": p.volume, "folder": p.folder} for k, p in places.items()}, sort_keys=True)
        self._store._write(f"places/{(found[-1] if found else 0) + 1}.json", text)

    def status(self, source: str) -> Place:
        return self.places().get(source, Place())

    def move(self, source: str, place: Place, old, new):
        """Copy the index (stores ``old`` and ``new``), check the copy, then name the new place; the old copy stays."""
        m = old.copy_to(new)
        self._put({**self.places(), source: place})
        return m

    def use_default(self, source: str) -> None:
        self._put({k: p for k, p in self.places().items() if k != source})


def command_json(values: dict) -> str:
    """A command's last line: JSON with sorted keys."""
    return json.dumps(values, sort_keys=True, separators=(",", ":"))
