"""Fixed virtual slots with DataFrame operations only.

A record is hashed into one of ``VIRTUAL_SLOTS`` virtual slots; the bytes of
each slot are summed, and a small, versioned table maps slots to shards. Growing
or rebalancing writes a next version in which some entries are edited, and so
moves those slots' records and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import new_dir, table

VIRTUAL_SLOTS = 4096
#: Parts of a virtual slot that are numbered apart; slots times parts are the rows of the plan.
PARTS = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1 as a long; a null text has size 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_hash(doc_id: Column, text: Column) -> Column:
    """64 bits of id and text: rows of one id, or of none, are spread by their texts. Nulls have a hash too."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def virtual_slot(record: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    """The virtual slot of a record's hash."""
    return F.pmod(record, F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Version 1: vslot, shard, version; slots are dealt round."""
    if not 0 < shards <= slots:
        raise ValueError("shards must be from 1 to the number of slots")
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(1).alias("version"))


def grow(slot_map: DataFrame) -> DataFrame:
    """The next version with one more shard, which takes an equal part of every old shard's slots; no other slot moves.

    The choice depends on slot numbers and counts only, never on the data.
    """
    n, version = slot_map.agg(F.max("shard") + 1, F.max("version") + 1).first()  # of a table of fixed size
    w = Window.partitionBy("shard").orderBy(F.xxhash64("vslot", F.lit(17)), "vslot")
    ranked = slot_map.withColumn("r", F.row_number().over(w))
    # Every (n+1)-th slot of a shard, the first at a place that differs by shard.
    taken = (F.col("r") + F.col("shard")) % (n + 1) == n
    return ranked.select("vslot", F.when(taken, F.lit(n)).otherwise(F.col("shard")).cast("int").alias("shard"), F.lit(version).alias("version"))


def slot_bytes(cells: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot in use, from ``cells``: vslot, n_rows, n_bytes."""
    return cells.groupBy("vslot").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


def rebalance(slot_map: DataFrame, loads: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The next version after moving slots from shards above the mean load by more than ``tolerance`` to the lightest.

    The map has a fixed number of rows, so the edit is planned on the driver.
    """
    spark = slot_map.sparkSession
    rows = slot_map.join(loads, "vslot", "left").select("vslot", "shard", "version", F.coalesce("n_bytes", F.lit(0)).alias("b")).collect()
    version = max(r.version for r in rows) + 1
    held: dict[int, list[tuple[int, int]]] = {r.shard: [] for r in rows}
    for r in rows:
        held[r.shard].append((r.b, r.vslot))
    load = {s: sum(b for b, _ in v) for s, v in held.items()}
    mean = sum(load.values()) / len(load)
    for _ in range(len(rows)):
        hi, lo = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        if load[hi] <= mean * (1 + tolerance):
            break
        gap = (load[hi] - load[lo]) / 2
        fits = [x for x in held[hi] if 0 < x[0] <= gap] or [x for x in held[hi] if 0 < x[0] < 2 * gap]
        if not fits:
            break
        x = max(fits)
        held[hi].remove(x)
        held[lo].append(x)
        load[hi] -= x[0]
        load[lo] += x[0]
    return spark.createDataFrame([(v, s, version) for s, xs in held.items() for _, v in xs], "vslot int, shard int, version int")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map, with its loads if it has them, to the table at ``path``. A version that is there already raises: versions don't change."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def latest_version(spark: SparkSession, path: str) -> int:
    """The greatest version at ``path``; 0 if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        return 0
    names = [str(x.getPath().getName()) for x in store.listStatus(p)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=0)


def records(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, record, vslot, part and n of the distinct records of ``docs``; ``n`` counts equal rows, before the shuffle too."""
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        size_of(text).alias("size"),
        F.coalesce(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        record_hash(docs["doc_id"], text).alias("record"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "record").agg(F.count("*").alias("n"))
    return rows.withColumn("vslot", virtual_slot(F.col("record"), slots)).withColumn("part", F.pmod(F.shiftrightunsigned("record", 40), F.lit(PARTS)).cast("int"))


def place(docs: DataFrame, shards: int = 16, slots: int = VIRTUAL_SLOTS, map_path: str | None = None, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, first_shard for every row of ``docs``.

    Where ``map_path`` holds a map, its latest version places the rows.
    Otherwise version 1 deals the slots round and version 2, which places them,
    is edited by the slots' bytes until no shard is above the mean by more than
    ``tolerance`` (or no move helps); ``first_shard`` is the shard of version 1.
    ``slot`` is the row's place in its shard, gapless from 0: records are
    numbered within a part of their virtual slot, and the parts of a shard
    follow each other, so no task ever sorts a whole shard or slot. Equal rows
    are counted, not sorted, and get one place each. Null texts have size 1 and
    checksum 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = map_path or new_dir(spark, "slots")
    found = table(records(docs, slots), "records")
    cells = table(found.groupBy("vslot", "part").agg(F.sum("n").alias("n_rows"), F.sum(F.col("size") * F.col("n")).alias("n_bytes")), "cells")
    version = latest_version(spark, path)
    if not version:
        first = initial_map(spark, shards, slots)
        store_map(first, path)
        store_map(rebalance(first, slot_bytes(cells), tolerance), path)
        version = 2
    first = load_map(spark, path, 1)
    now = load_map(spark, path, version)
    at = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    plan = now.select("vslot", "shard").join(first.select("vslot", F.col("shard").alias("first_shard")), "vslot").join(cells, "vslot")
    plan = plan.select("vslot", "part", "shard", "first_shard", F.coalesce(F.sum("n_rows").over(at), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("vslot", "part").orderBy("doc_id", "size", "text_crc32", "record").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(plan), ["vslot", "part"])  # a row per slot and part
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("offset") + F.col("before"), F.col("offset") + F.col("before") + F.col("n") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "first_shard",
    )
