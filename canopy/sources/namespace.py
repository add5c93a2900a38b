"""Namespace rows: from the star-schema tables, from a directory tree, or synthetic."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import events as ev
from canopy.functions import paths
from canopy.functions.text import fold_ascii, with_folded
from canopy.sources.work import small, work_table

ENTRY = T.StructType(
    [
        T.StructField("volume", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("device_id", T.LongType()),
        T.StructField("file_id", T.DecimalType(20, 0)),
        T.StructField("is_mount_point", T.BooleanType()),
        T.StructField("size", T.DecimalType(20, 0)),
        T.StructField("mtime", T.LongType()),
    ]
)
KIND_CODES = {"file": 1, "directory": 2, "symlink": 3, "other": 4}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, moved_once: bool = False) -> DataFrame:
    """One file or link per supplier and part: volume, path, parent, name, folded, kind, size, mtime, file_id, part.

    With ``moved_once`` the lines are shuffled once, by part, and the rows come
    in that order: less disk and smaller files, for one more count.
    """
    lines = read(spark, sf_dir, "lineitem")
    lines = (lines.repartition("l_partkey") if moved_once else lines).groupBy("l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"), F.round(F.max("l_extendedprice") * 100).cast("long").alias("cents"), F.max("l_shipdate").alias("shipped"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name", F.col("p_partkey").cast("string")).alias("label"))
    place = (
        read(spark, sf_dir, "supplier")
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("volume"), F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name", "s_name")).alias("parent"))
    )
    place = small(place) if moved_once else place
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    link = F.col("flag") == "N"
    name = F.concat(F.col("label"), F.lit(".dat"))
    return rows.select(
        "volume",
        F.concat("parent", F.lit("/"), name).alias("path"),
        "parent",
        name.alias("name"),
        fold_ascii(name).alias("folded"),
        F.when(link, "symlink").otherwise("file").alias("kind"),
        F.when(~link, F.col("cents")).alias("size"),
        (F.unix_seconds(F.col("shipped").cast("timestamp")) * 1_000_000_000).alias("mtime"),
        (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("file_id"),
        F.col("l_partkey").alias("part"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and all their directories: volume, path, parent, name, folded, kind."""
    some = files(spark, sf_dir).select("volume", "path", "parent", "name", "folded", "kind")
    return some.unionByName(directories(some.select("volume", F.explode(paths.ancestors(F.col("path"))).alias("path"))))


def directories(up: DataFrame) -> DataFrame:
    """The directories of ``up(volume, path)``: volume, path, parent, name, folded, kind."""
    name = paths.basename(F.col("path"))
    return up.distinct().select("volume", "path", paths.parent(F.col("path")).alias("parent"), name.alias("name"), fold_ascii(name).alias("folded"), F.lit("directory").alias("kind"))


EVENT_FLAGS = {
    "signup": ev.bits("created", "is_file"),
    "purchase": ev.bits("modified", "is_file"),
    "click": ev.bits("renamed", "is_file"),
    "error": ev.bits("removed", "is_file"),
    "view": ev.bits("xattr", "is_file"),
}


def event_flags(event_type: Column, event_id: Column) -> Column:
    """Flags of a table event; a few ids get a special or an unknown bit."""
    f = F.lit(0)
    for name, value in EVENT_FLAGS.items():
        f = F.when(event_type == name, F.lit(value)).otherwise(f)
    extra = (
        F.when(event_id % 97 == 0, F.lit(ev.FLAGS["must_scan"]))
        .when(event_id % 89 == 0, F.lit(ev.FLAGS["created"]))
        .when(event_id % 83 == 0, F.lit(ev.FLAGS["is_dir"]))
        .when(event_id % 79 == 0, F.lit(ev.KNOWN + 1))
        .when(event_id % 73 == 0, F.lit(ev.FLAGS["kernel_dropped"]))
        .when(event_id % 71 == 0, F.lit(ev.FLAGS["history_done"]))
        .otherwise(F.lit(0))
    )
    return f.bitwiseOR(extra).cast("long")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change stream: id, path, flags."""
    e = read(spark, sf_dir, "events")
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/k"), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("id"), path.alias("path"), event_flags(F.col("event_type"), F.col("event_id")).alias("flags"))


# ---------------------------------------------------------------- directory trees


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level of listings; a directory that can't be read is a row with its error."""
    names = ["volume", "path", "kind", "device_id", "file_id", "is_mount_point", "size", "mtime", "error"]
    for b in batches:
        for volume, top in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows: list[tuple] = []
            try:
                with os.scandir(top) as it:
                    for e in it:
                        s = e.stat(follow_symlinks=False)
                        kind = "symlink" if e.is_symlink() else "directory" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other"
                        rows.append((volume, e.path, kind, s.st_dev, s.st_ino or None, kind == "directory" and os.path.ismount(e.path), s.st_size if kind == "file" else None, s.st_mtime_ns, None))
            except OSError as x:
                rows.append((volume, top, None, None, None, None, None, None, x.strerror))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


LISTING = "volume string, path string, kind string, device_id long, file_id long, is_mount_point boolean, size long, mtime long, error string"


def scan(spark: SparkSession, volume: str, root: str, excluded: tuple[str, ...] = (), workers: int = 8) -> DataFrame:
    """Breadth-first walk of a mounted tree, a level at a time, directories dealt over tasks.

    Links aren't followed; mount points and other devices aren't entered; an
    unreadable root fails, other failures are rows with ``error`` set.
    """
    top = os.stat(root)
    level = spark.createDataFrame([(volume, root)], "volume string, path string")
    out = None
    while True:
        found = work_table(level.repartition(workers).mapInArrow(_listed, LISTING).where(~F.col("path").isin(list(excluded)) if excluded else F.lit(True)), "level")
        if out is None and (bad := found.where(F.col("error").isNotNull()).first()):
            raise OSError(f"{root}: {bad.error}")
        out = found if out is None else out.unionByName(found)
        level = found.where((F.col("kind") == "directory") & ~F.col("is_mount_point") & (F.col("device_id") == top.st_dev)).select("volume", "path")
        if level.isEmpty():
            return out


def traversable(root_device: Column) -> Column:
    """Whether an entry's children belong to the walk."""
    return (F.col("kind") == "directory") & ~F.col("is_mount_point") & (F.col("device_id") == root_device)


def synthetic(spark: SparkSession, n: int, per_directory: int = 4096) -> DataFrame:
    """``n`` files in directories of a fixed size, every hundredth with an accented, decomposed name."""
    i = F.col("id")
    stem = F.when(i % 100 == 0, F.lit("Café-")).otherwise(F.lit("File-"))
    name = F.concat(stem, F.lpad(i.cast("string"), 10, "0"), F.lit(".dat"))
    parent = F.concat(F.lit("/synthetic/dir-"), F.lpad(F.floor(i / per_directory).cast("string"), 6, "0"))
    rows = spark.range(n).select(
        F.lit("synthetic").alias("volume"), F.concat(parent, F.lit("/"), name).alias("path"), parent.alias("parent"), name.alias("name"), F.lit("file").alias("kind"), (i % 65536 + 1).alias("size"), (F.lit(1_700_000_000_000_000_000) + 3 * i).alias("mtime")
    )
    return with_folded(rows)
