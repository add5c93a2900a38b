"""An immutable base under a mutable overlay: merge, mutation rules, diff and verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import paths
from canopy.operators.tree import root_devices
from canopy.sources.work import Marks, small, work_table

KEY = ["volume", "path"]


def merged(base: DataFrame, tombstones: DataFrame, delta: DataFrame) -> DataFrame:
    """Base rows that are neither removed nor replaced, and the overlay's rows."""
    gone = tombstones.select(*KEY).unionByName(delta.select(*KEY)).distinct()
    return base.join(gone, KEY, "left_anti").unionByName(delta.select(*base.columns))


def last_per_path(mutations: DataFrame) -> DataFrame:
    """The last mutation of each path in a batch, by ``seq``: a max before and after the shuffle, no sort."""
    others = [c for c in mutations.columns if c not in KEY]
    best = mutations.groupBy(*KEY).agg(F.max_by(F.struct(*others), "seq").alias("m"))
    return best.select(*KEY, "m.*")


def subtree_tombstones(base: DataFrame, removed: DataFrame) -> DataFrame:
    """Base rows at or below a removed path; ``/a`` doesn't cover ``/ab``."""
    up = base.select("volume", "path", F.explode(paths.ancestors(F.col("path"), proper=False)).alias("root"))
    hit = up.join(removed.select("volume", F.col("path").alias("root")).distinct(), ["volume", "root"], "left_semi")
    return base.join(hit.select(*KEY).distinct(), KEY, "left_semi")


IDENTITY = ("device_id", "file_id", "is_mount_point")


def same_directory(a: str, b: str, columns: list[str]) -> Column:
    """Whether two structs are one directory: both are directories of equal device, file id and mount state, as far as there are such columns."""
    same = (F.col(f"{a}.kind") == "directory") & (F.col(f"{b}.kind") == "directory")
    for c in IDENTITY:
        if c in columns:
            same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def replaced_directories(base: DataFrame, upserts: DataFrame) -> DataFrame:
    """Directories of ``base`` that an upsert turns into something else or into another directory."""
    shared = [c for c in base.columns if c in upserts.columns]
    old = base.where("kind = 'directory'").select(*KEY, F.struct(*shared).alias("was"))
    new = upserts.select(*KEY, F.struct(*shared).alias("now"))
    return old.join(new, KEY).where(~same_directory("was", "now", shared)).select(*KEY)


@dataclass
class Applied:
    live: DataFrame
    tombstones: DataFrame
    delta: DataFrame


def _kills(touched: DataFrame, ops: DataFrame, columns: list[str]) -> DataFrame:
    """(volume, root, seq, own) of what ends all that is below ``root`` before ``seq``: removals (``own``: the root too), and upserts of something else than was there."""
    rows = touched.select(*KEY, F.lit(-1).cast("long").alias("seq"), F.lit("upsert").alias("op"), F.struct(*columns).alias("now"))
    rows = rows.unionByName(ops.select(*KEY, F.col("seq").cast("long").alias("seq"), "op", F.struct(*columns).alias("now")))
    w = Window.partitionBy(*KEY).orderBy("seq")  # the mutations of one path
    rows = rows.withColumn("before", F.lag(F.struct("op", F.col("now").alias("was"))).over(w)).withColumn("was", F.col("before.was"))
    other = (F.col("op") == "upsert") & (F.col("before.op") == "upsert") & ~same_directory("was", "now", columns)
    return rows.where((F.col("op") == "remove") | other).select("volume", F.col("path").alias("root"), "seq", (F.col("op") == "remove").alias("own"))


def apply_mutations(base: DataFrame, mutations: DataFrame) -> Applied:
    """A batch of ``mutations(op, seq, *base columns)`` with op upsert or remove, as if applied one by one in the order of ``seq``.

    A removal ends the subtree as it is then; so does an upsert that puts
    something else in a directory's place. Roots (``/``) stay. An upsert needs a
    live directory as its parent at its time, in the base or from the batch, that
    is no mount point and on the root's device (where there are such columns);
    else it is ignored, and what is below it too. Nothing changes for an upsert
    equal to the live row.
    """
    columns = base.columns
    ops = mutations.where("path <> '/'").withColumn("seq", F.col("seq").cast("long"))
    ops = work_table(ops.where(paths.normalize(F.col("path")).eqNullSafe(F.col("path"))), "mutations")
    # Only base rows near a mutated path are stored and joined by path; the others are read where they are.
    near, far = Marks(ops, KEY).split(base)
    near = work_table(near, "near")
    touched = near.join(ops.select(*KEY).distinct(), KEY, "left_semi")
    kills = work_table(_kills(touched, ops, columns), "kills")
    roots = kills.groupBy("volume", "root").agg(F.max("seq").alias("below"), F.max(F.when(F.col("own"), F.col("seq"))).alias("self"))

    def last_end(rows: DataFrame) -> DataFrame:
        """When each path was last ended from above or by its own removal."""
        up = rows.select(*KEY).distinct().select(*KEY, F.explode(paths.ancestors(F.col("path"), proper=False)).alias("root"))
        hit = up.join(roots, ["volume", "root"])
        return hit.groupBy(*KEY).agg(F.max(F.when(F.col("root") == F.col("path"), F.col("self")).otherwise(F.col("below"))).alias("ended")).where("ended IS NOT NULL")

    # What ends a directory's children ends all of them, so their directories are looked up, not they.
    here = lambda rows: rows.withColumn("_up", paths.parent(F.col("path")))
    above = here(base.where("path <> '/'")).select("volume", "_up").distinct()
    above = above.select("volume", "_up", F.explode(paths.ancestors(F.col("_up"), proper=False)).alias("root"))
    ended_in = small(work_table(above.join(roots.where("below IS NOT NULL"), ["volume", "root"], "left_semi").select("volume", "_up").distinct(), "ended"))
    own = roots.where("self IS NOT NULL").select("volume", F.col("root").alias("path"))
    below = lambda rows, how: here(rows).join(ended_in, ["volume", "_up"], how).drop("_up").select(*columns)
    gone_alone = below(near.where("path <> '/'"), "left_anti").join(own, KEY, "left_semi").select(*columns)
    tombstones = work_table(below(base.where("path <> '/'"), "left_semi").unionByName(gone_alone), "tombstones")
    far = below(far, "left_anti")
    near = work_table(near.where("path = '/' OR path IS NULL").unionByName(below(near.where("path <> '/'"), "left_anti").join(own, KEY, "left_anti").select(*columns)), "kept")
    ended = last_end(ops)
    upserts = ops.where("op = 'upsert'").join(ended, KEY, "left").where("ended IS NULL OR seq > ended")
    wanted = upserts.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "seq").alias("row"), F.sort_array(F.collect_set("seq")).alias("seqs"))  # the mutations of one path
    in_base = near.join(wanted.select(*KEY), KEY, "left_semi").select(*KEY, F.lit(True).alias("stays"))
    wanted = work_table(wanted.join(in_base, KEY, "left").withColumn("up", paths.parent(F.col("path"))), "wanted")

    def parents(rows: DataFrame, start: Column) -> DataFrame:
        """Directories that may hold children, with the time from which they do."""
        rows = rows.where("kind = 'directory'")
        if "is_mount_point" in columns:
            rows = rows.where(~F.coalesce("is_mount_point", F.lit(False)) | (F.col("path") == "/"))
        if "device_id" in columns:
            rows = rows.join(root_devices(base), "volume", "left").where(F.coalesce("device_id", F.lit(0)).isin(0) | F.coalesce(F.col("device_id") == F.col("_root_device"), F.lit(True)))
        return rows.select("volume", F.col("path").alias("up"), start.alias("start"))

    # Upserts whose parent is in the base come first, then level by level those below what the batch brings.
    asked = small(work_table(wanted.select("volume", F.col("up").alias("path")).distinct(), "asked"))
    folders = parents(far.unionByName(near.join(wanted.select(*KEY), KEY, "left_anti").select(*columns)).where("kind = 'directory'").join(asked, KEY, "left_semi").select(*columns), F.lit(-1).cast("long"))
    accepted, pending = None, wanted
    while True:
        first = F.when(F.col("stays"), F.lit(-1).cast("long")).otherwise(F.get(F.filter("seqs", lambda x: x > F.col("start")), F.lit(0)))
        new = pending.join(folders, ["volume", "up"]).withColumn("since", first).where("since IS NOT NULL").select("volume", "up", "path", "row", "seqs", "stays", "since")
        new = work_table(new, "accepted")
        accepted = new if accepted is None else accepted.unionByName(new)
        pending = pending.join(new.select(*KEY), KEY, "left_anti")
        folders = parents(new.select("row.*", "since"), F.col("since"))
        if new.where("row.kind = 'directory'").isEmpty():
            break
    delta = accepted.select("row.*")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"u.{c}")) for c in columns]
    equal = same[0]
    for x in same[1:]:
        equal = equal & x
    there = [F.col("u.volume") == F.col("b.volume"), F.col("u.path") == F.col("b.path")]
    unchanged = delta.alias("u").join(near.alias("b"), there).where(equal).select("u.volume", "u.path")
    delta = work_table(delta.join(unchanged, KEY, "left_anti").select(*columns), "delta")
    return Applied(far.unionByName(near.join(delta.select(*KEY), KEY, "left_anti").select(*columns)).unionByName(delta), tombstones, delta)


#: A batch beyond these needs a rebuild rather than an overlay.
MAX_ROWS, MAX_BYTES, MAX_SUBTREE = 500_000, 128 * 2**20, 100_000


def overlay_size(delta: DataFrame) -> DataFrame:
    """One row: rows and estimated bytes of an overlay."""
    each = F.lit(192) + 2 * F.octet_length("path") + F.octet_length("name") + F.octet_length("folded")
    return delta.agg(F.count("*").alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("bytes"))


def overflow(delta: DataFrame, tombstones: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: whether the overlay is beyond its limits, or one removal takes more rows than an overlay may (``removed`` has the paths)."""
    up = tombstones.select("volume", F.explode(paths.ancestors(F.col("path"), proper=False)).alias("root"))
    widest = up.join(removed.select("volume", F.col("path").alias("root")).distinct(), ["volume", "root"]).groupBy("volume", "root").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("subtree"))
    both = overlay_size(delta).crossJoin(widest)  # of one row each
    over = (F.col("rows") >= MAX_ROWS) | (F.col("bytes") >= MAX_BYTES)
    return both.select("rows", "bytes", "subtree", over.alias("full"), (over | (F.col("subtree") > MAX_SUBTREE)).alias("rebuild"))


def ordered_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Mutations from one listing to another: removals in old order, then upserts in new order.

    Both have ``pos``, ``path`` and ``columns``. A new row is an upsert unless
    it equals the last old row of its path; duplicates stay.
    """
    last = old.groupBy("path").agg(F.max_by(F.struct(*columns), "pos").alias("_old"))
    gone = old.join(new.select("path").distinct(), "path", "left_anti").select(F.lit("remove").alias("op"), "pos", "path", *columns)
    fresh = new.join(last, "path", "left").where(~F.col("_old").eqNullSafe(F.struct(*columns))).select(F.lit("upsert").alias("op"), "pos", "path", *columns)
    return gone.unionByName(fresh)


def verify(actual: DataFrame, index: DataFrame) -> DataFrame:
    """Differences of two path sets: volume, path, class missing (from the index) or extra."""
    a, b = actual.select(*KEY).distinct(), index.select(*KEY).distinct()
    return a.join(b, KEY, "left_anti").withColumn("class", F.lit("missing")).unionByName(b.join(a, KEY, "left_anti").withColumn("class", F.lit("extra")))


def revalidated(differences: DataFrame, probes: DataFrame, index: DataFrame) -> DataFrame:
    """Differences after a second look: ``probes(volume, path, state)`` with present, absent or unknown.

    An unknown (or no) probe keeps the class; one that agrees with the index is
    raced; otherwise present is missing and absent is extra.
    """
    indexed = index.select(*KEY).distinct().withColumn("_in", F.lit(True))
    both = differences.join(probes, KEY, "left").join(indexed, KEY, "left")
    there, known = F.col("state") == "present", F.coalesce(F.col("_in"), F.lit(False))
    final = F.when(F.coalesce(F.col("state"), F.lit("unknown")) == "unknown", F.col("class")).when(there == known, "raced").when(there, "missing").otherwise("extra")
    return both.select(*KEY, final.alias("class"))


def compaction_due(stats: DataFrame) -> DataFrame:
    """Adds ``due`` to rows of delta_rows, delta_bytes, dead_rows, base_rows, quiet_seconds."""
    share = lambda c: F.col(c) * 20 >= F.col("base_rows")
    some = (F.col("delta_rows") >= 50_000) | (F.col("delta_bytes") >= 64 * 2**20) | (F.col("dead_rows") >= 50_000) | ((F.col("base_rows") > 0) & ((share("dead_rows") & (F.col("dead_rows") > 0)) | (share("delta_rows") & (F.col("delta_rows") > 0))))
    return stats.withColumn("due", (some & (F.col("quiet_seconds") >= 2)) | (F.col("delta_bytes") >= 128 * 2**20))


def dup_names_last_wins(arrivals: DataFrame) -> DataFrame:
    """Of equal names in one directory the last arrival stays."""
    w = Window.partitionBy("volume", "parent", "name").orderBy(F.col("arrival").desc())
    return arrivals.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def layered_metadata(rows: DataFrame, base: DataFrame, delta: DataFrame, removed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Sizes and times of ``rows(volume, path)``: removed is unknown, then the overlay, then a renamed directory's old path, then the base.

    ``aliases(volume, new_root, old_root)``: the longest new root that covers a
    path is the one that counts.
    """
    out = rows.join(removed.select(*KEY).distinct().withColumn("_gone", F.lit(True)), KEY, "left")
    out = out.join(delta.select(*KEY, F.struct("size", "mtime").alias("_delta")), KEY, "left")
    source = F.col("path")
    if aliases is not None:
        up = rows.select(*KEY).distinct().select(*KEY, F.explode(paths.ancestors(F.col("path"), proper=False)).alias("new_root"))
        best = up.join(aliases, ["volume", "new_root"]).groupBy(*KEY).agg(F.max_by(F.struct("new_root", "old_root"), F.length("new_root")).alias("_alias"))
        out = out.join(best, KEY, "left")
        source = F.when(F.col("_alias").isNotNull(), F.concat("_alias.old_root", F.expr("substring(path, length(_alias.new_root) + 1)"))).otherwise(F.col("path"))
    out = out.withColumn("_source", source)
    stored = base.select("volume", F.col("path").alias("_source"), F.struct("size", "mtime").alias("_base"))
    out = out.join(stored, ["volume", "_source"], "left")
    value = F.when(F.col("_gone"), F.lit(None)).otherwise(F.coalesce("_delta", "_base"))
    return out.withColumn("_v", value).select(*rows.columns, F.col("_v.size").alias("size"), F.col("_v.mtime").alias("mtime"))


def rename_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Old and new path of what kept its device and file id within a batch."""
    a = removed.select("device_id", "file_id", F.col("path").alias("old_path"))
    return a.join(added.select("device_id", "file_id", F.col("path").alias("new_path")), ["device_id", "file_id"]).where("old_path <> new_path")
