"""Trees of paths: roots, children, subtrees, preorder numbering and reconstruction.

Prefix relations become equi-joins by exploding the ancestors of a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import paths
from canopy.functions.text import fold_text, with_folded
from canopy.sources.work import work_table


def minimal_roots(df: DataFrame, path: str = "path") -> DataFrame:
    """Normalized distinct paths without those that have a proper ancestor among them; invalid ones are dropped."""
    roots = df.select(paths.normalize(F.col(path)).alias("path")).where("path IS NOT NULL").distinct()
    up = roots.select("path", F.explode(paths.ancestors(F.col("path"))).alias("up"))
    covered = up.join(roots.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return roots.join(covered, "path", "left_anti")


def outside(df: DataFrame, roots: DataFrame, path: str = "path", inside: bool = False) -> DataFrame:
    """Rows that no root of ``roots(root)`` covers (or, ``inside``, those that one does)."""
    up = df.select(path).distinct().select(path, F.explode(paths.ancestors(F.col(path), proper=False)).alias("root"))
    covered = up.join(roots.select("root").distinct(), "root", "left_semi").select(path).distinct()
    return df.join(covered, path, "left_semi" if inside else "left_anti")


def nearest_ancestor(df: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """Each distinct path with its deepest proper ancestor in ``known(path)``; null if there is none."""
    up = df.select(path).distinct().select(path, F.explode(paths.ancestors(F.col(path))).alias("up"))
    hit = up.join(known.select(F.col("path").alias("up")).distinct(), "up")
    best = hit.groupBy(path).agg(F.max_by("up", F.length("up")).alias("nearest"))
    return df.select(path).distinct().join(best, path, "left")


def children_of(entries: DataFrame, volume: str, path: str) -> DataFrame:
    """Direct children in path order; none below what isn't a directory."""
    own = entries.where((F.col("volume") == volume) & (F.col("path") == path) & (F.col("kind") == "directory")).select("volume", F.col("path").alias("parent"))
    return entries.where((F.col("volume") == volume) & (F.col("parent") == path) & (F.col("path") != path)).join(own, ["volume", "parent"], "left_semi").orderBy("path")


def subtree_of(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(paths.is_within(F.col("path"), F.lit(path)))


def child_counts(entries: DataFrame) -> DataFrame:
    return entries.where("path <> parent").groupBy("volume", "parent").agg(F.count("*").alias("children"))


def numbered(df: DataFrame, order: list, group: str, name: str) -> DataFrame:
    """Row numbers from 0 within each ``group``, without a task per group.

    Rows are range-partitioned by group and order; each partition numbers its
    own, and the few counts per partition and group give the offsets.
    """
    dealt = df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    dealt = work_table(dealt, "numbered")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part", group).agg(F.count("*").alias("_n")).select("_part", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_part", group).orderBy(*order)
    return dealt.withColumn("_local", F.row_number().over(local) - 1).join(offsets, ["_part", group]).withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_local", "_before")


def preorder(entries: DataFrame) -> DataFrame:
    """Entries with ``ordinal`` (preorder from 0), ``subtree_end`` and ``child_count`` per volume."""
    keyed = with_folded(entries, "path", "_folded").withColumn("_key", paths.preorder_key(F.col("path"), F.col("_folded"))).drop("_folded")
    rows = numbered(keyed, [F.col("_key")], "volume", "ordinal").drop("_key")
    # Counts are made before the shuffle, so a root above all rows is a row per task.
    below = entries.select("volume", F.explode(paths.ancestors(F.col("path"))).alias("path")).groupBy("volume", "path").agg(F.count("*").alias("_below"))
    kids = child_counts(entries).select("volume", F.col("parent").alias("path"), F.col("children").alias("child_count"))
    out = rows.join(below, ["volume", "path"], "left").join(kids, ["volume", "path"], "left")
    return out.withColumn("subtree_end", F.col("ordinal") + 1 + F.coalesce("_below", F.lit(0))).withColumn("child_count", F.coalesce("child_count", F.lit(0))).drop("_below")


def reconstruct(nodes: DataFrame, max_depth: int = 2048) -> DataFrame:
    """Paths of ``nodes(volume, id, parent_id, name)`` by pointer doubling: joins grow with the logarithm of the depth.

    A root has itself as parent.
    """
    step = nodes.select("volume", "id", F.col("parent_id").alias("up"), F.when(F.col("id") == F.col("parent_id"), "").otherwise(F.concat(F.lit("/"), "name")).alias("tail"))
    for _ in range(max(1, max_depth.bit_length())):
        other = step.select("volume", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("tail").alias("tail2"))
        nxt = step.join(other, ["volume", "up"]).select("volume", "id", F.col("up2").alias("up"), F.concat(F.when(F.col("up") == F.col("id"), "").otherwise(F.col("tail2")), "tail").alias("tail"), (F.col("up2") != F.col("up")).alias("moved"))
        nxt = work_table(nxt, "paths")
        step = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    return step.select("volume", "id", F.when(F.col("tail") == "", "/").otherwise(F.col("tail")).alias("path"))


def with_parents(entries: DataFrame) -> DataFrame:
    """The loader's rule: missing ancestors become directories, and what has children is one."""
    up = entries.select("volume", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("_up", F.lit(True))
    both = entries.select("volume", "path", "kind").join(up, ["volume", "path"], "full")
    return both.select("volume", "path", F.when(F.col("_up"), "directory").otherwise(F.col("kind")).alias("kind"))


def resolvable(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (volume, path) that exist and that no link, file, mount point or (where entries tell their device) other device stands above."""
    there = asked.join(entries.select("volume", "path"), ["volume", "path"], "left_semi")
    up = there.select("volume", "path", F.explode(paths.ancestors(F.col("path"))).alias("up"))
    open_ = F.col("kind") == "directory"
    if "is_mount_point" in entries.columns:
        open_ = open_ & (~F.coalesce("is_mount_point", F.lit(False)) | (F.col("path") == "/"))
    walls = entries
    if "device_id" in entries.columns:
        walls = walls.join(root_devices(entries), "volume", "left")
        open_ = open_ & (F.coalesce("device_id", F.lit(0)).isin(0) | F.coalesce(F.col("device_id") == F.col("_root_device"), F.lit(True)))
    walls = walls.where(~open_).select("volume", F.col("path").alias("up"))
    blocked = up.join(walls, ["volume", "up"], "left_semi").select("volume", "path").distinct()
    return there.join(blocked, ["volume", "path"], "left_anti")


def root_devices(entries: DataFrame) -> DataFrame:
    """The device of each volume's root: a row per volume."""
    return entries.where("path = '/'").groupBy("volume").agg(F.max("device_id").alias("_root_device"))


def lookup_child(entries: DataFrame, volume: str, parent: str, name: str) -> DataFrame:
    """The child of that name; where none has it byte for byte, those of the same folded group that are canonically equal (composed or not)."""
    import unicodedata

    nfc = F.udf(lambda s: s and unicodedata.normalize("NFC", s), "string")
    group = entries.where((F.col("volume") == volume) & (F.col("parent") == parent) & (F.col("path") != parent) & (F.col("folded") == fold_text(name)))  # few rows: one folded name of one directory
    equal = group.where(nfc("name") == unicodedata.normalize("NFC", name)).withColumn("_exact", F.col("name") == name)
    best = Window.partitionBy("volume", "parent").orderBy(F.col("_exact").desc(), "name")
    return equal.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_exact", "_n")
