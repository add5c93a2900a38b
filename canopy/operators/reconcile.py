"""Dirty scopes and patches held against current truth: what was listed again becomes mutations.

``existing`` are the live rows, ``actual`` what a listing gives now; both have
volume, path, parent and the entry's columns. All directories of a batch are
compared in one pass, so a batch costs two joins however many scopes it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import events as ev
from canopy.functions import paths
from canopy.operators import changes, overlay
from canopy.operators.tree import minimal_roots
from canopy.sources.work import Marks, small, work_table

KEY = ["volume", "path"]
#: More mutations than these, or a listed directory with more old children, and the base is built again.
MAX_MUTATIONS = MAX_CHILDREN = 100_000
#: Names that one micro-batch asks for; a directory is listed whole if more than an eighth of it is asked.
SPARSE_NAMES = 64


def in_scopes(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows whose directory is to be listed: a root of ``scopes(volume, root, subtree)``, or below one with ``subtree``."""
    roots = scopes.groupBy("volume", "root").agg(F.max("subtree").alias("subtree"))
    up = rows.select("volume", "parent").distinct().select("volume", "parent", F.explode(paths.ancestors(F.col("parent"), proper=False)).alias("root"))
    hit = up.join(roots, ["volume", "root"]).where((F.col("root") == F.col("parent")) | F.col("subtree")).select("volume", "parent").distinct()
    return rows.where("path <> parent").join(small(work_table(hit, "listed")), ["volume", "parent"], "left_semi")


def digest(columns: list[str]) -> Column:
    """64 bits of a row; nulls count, as a hash alone passes over them."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def maybe_changed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without rows that are equal on either side, as far as digests tell.

    A key's rows go unless it has one on either side and their digests agree;
    keys that share a hash stay. So the rows themselves needn't be shuffled.
    """
    columns = old.columns
    side = lambda rows, at: rows.select(F.xxhash64(*KEY).alias("_key"), digest(columns).alias("_row"), F.lit(at).alias("_side"))
    # Nearly every key has two rows: nothing to sum up before the shuffle.
    both = side(old, 0).unionByName(side(new, 1)).repartition("_key").groupBy("_key")
    per = both.agg(F.count("*").alias("n"), F.sum("_side").alias("new"), F.min("_row").alias("lo"), F.max("_row").alias("hi"))
    differ = Marks(per.where("n <> 2 OR new <> 1 OR lo <> hi").select("_key"), ["_key"])
    return tuple(differ.split(rows.withColumn("_key", F.xxhash64(*KEY)))[0].select(*columns) for rows in (old, new))


def reconcile(existing: DataFrame, actual: DataFrame, scopes: DataFrame) -> DataFrame:
    """Mutations (op, seq, entry columns) that make the listed scopes of ``existing`` equal to ``actual``.

    Removals come first, then upserts from the top down. Below a directory that
    is new, or another one than before, all that is there now is an upsert,
    whether it was asked for or not.
    """
    columns = existing.columns
    actual = actual.select(*columns)
    # What is listed may be most of the tree; what differs in it is stored.
    scopes = work_table(scopes.select("volume", "root", "subtree"), "scopes")
    old, new = maybe_changed(in_scopes(existing, scopes), in_scopes(actual, scopes))
    old, new = work_table(old, "old"), work_table(new, "new")
    gone = old.join(new.select(*KEY), KEY, "left_anti")
    pairs = new.alias("n").join(old.alias("o"), [F.col("n.volume") == F.col("o.volume"), F.col("n.path") == F.col("o.path")], "left")
    equal = F.col("o.path").isNotNull()
    for c in columns:
        equal = equal & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    kept = F.coalesce(overlay.same_directory("n", "o", columns), F.lit(False))
    upserts = pairs.where(~equal).select("n.*").select(*columns)
    fresh = work_table(pairs.where((F.col("n.kind") == "directory") & ~kept).select("n.volume", F.col("n.path").alias("root"), F.lit(True).alias("subtree")), "fresh")
    if not fresh.isEmpty():
        upserts = upserts.unionByName(in_scopes(actual, fresh))
    upserts = upserts.distinct()
    seq = lambda rows, op, at: rows.select(F.lit(op).alias("op"), at.cast("long").alias("seq"), *columns)
    return seq(gone, "remove", F.lit(0)).unionByName(seq(upserts, "upsert", 1 + paths.depth(F.col("path"))))


def authoritative(patches: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches ``(volume, path)`` against current truth: mutations, and the parents to list.

    What isn't there is removed; what is there is upserted; for a directory its
    parent is listed, as its contents may have come with it.
    """
    columns = actual.columns
    found = patches.select(*KEY).distinct().join(actual, KEY, "left").select(*columns)
    there = F.col("kind").isNotNull()
    op = F.when(there, "upsert").otherwise("remove")
    seq = F.when(there, 1 + paths.depth(F.col("path"))).otherwise(F.lit(0)).cast("long")
    mutations = found.where(~there | (F.col("kind") != "directory")).select(op.alias("op"), seq.alias("seq"), *columns)
    dirty = found.where("kind = 'directory'").select("volume", paths.parent(F.col("path")).alias("root"), F.lit(False).alias("subtree")).distinct()
    return mutations, dirty


def live_after(base: DataFrame, events: DataFrame, actual: DataFrame, floor: int = 0, storm: int = changes.STORM) -> overlay.Applied:
    """A batch of one volume's ``events(volume, id, path, flags)`` planned, held against ``actual`` and applied to ``base``."""
    volume = events.select("volume").distinct()
    plan = changes.plan_batch(events.drop("volume"), floor, storm)
    per = lambda df: df.crossJoin(F.broadcast(volume))  # noqa: E731  (one row)
    patches, dirty = authoritative(per(plan["patches"].select("path")), actual)
    scopes = per(plan["scopes"]).select("volume", "root", "subtree").unionByName(dirty)
    listed = reconcile(base, actual, scopes)
    both = listed.unionByName(patches.join(listed.select(*KEY).distinct(), KEY, "left_anti"))
    return overlay.apply_mutations(base, both.select("op", "seq", *base.columns))


def needs_rebuild(mutations: DataFrame, existing: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row: whether a plan is too large for a patch."""
    widest = in_scopes(existing, scopes).groupBy("volume", "parent").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("widest"))
    n = mutations.agg(F.count("*").alias("mutations"))
    return n.crossJoin(widest).select("mutations", "widest", ((F.col("mutations") > MAX_MUTATIONS) | (F.col("widest") > MAX_CHILDREN)).alias("rebuild"))  # of one row each


def metadata_hints(mutations: DataFrame) -> DataFrame:
    """Events for sizes and times after names have changed: each changed parent, and each removed path. Their id 0 is never taken for old."""
    parents = mutations.select("volume", paths.parent(F.col("path")).alias("path")).distinct().withColumn("flags", F.lit(ev.FLAGS["xattr"]).cast("long"))
    gone = mutations.where("op = 'remove'").select("volume", "path").distinct().withColumn("flags", F.lit(ev.FLAGS["removed"]).cast("long"))
    return parents.unionByName(gone).withColumn("id", F.lit(0).cast("long"))


def discovered(mutations: DataFrame, actual: DataFrame) -> DataFrame:
    """All rows of directories that a batch brought: their sizes and times are to be read, too."""
    roots = mutations.where("op = 'upsert' AND kind = 'directory'").select("volume", F.col("path").alias("root")).distinct()
    up = actual.select(*KEY, F.explode(paths.ancestors(F.col("path"), proper=False)).alias("root"))
    return actual.join(up.join(roots, ["volume", "root"], "left_semi").select(*KEY).distinct(), KEY, "left_semi")


def lookup_plan(asked: DataFrame, siblings: DataFrame, collapse: int = changes.COLLAPSE) -> DataFrame:
    """How the sizes and times of ``asked(volume, path)`` are read: names, bulk or collapse for each parent, and in how many micro-batches.

    Few names beside many ``siblings(volume, parent, children)`` are asked one by one.
    """
    per = asked.select("volume", paths.parent(F.col("path")).alias("parent"), "path").groupBy("volume", "parent").agg(F.countDistinct("path").alias("requested"))
    both = per.join(siblings, ["volume", "parent"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    way = F.when(F.col("requested") >= collapse, "collapse").when(F.col("requested") * 8 < F.col("children"), "names").otherwise("bulk")
    return both.withColumn("way", way).withColumn("batches", F.when(F.col("way") == "names", F.ceil(F.col("requested") / SPARSE_NAMES)).otherwise(1).cast("int"))


def lookup_keys(asked: DataFrame) -> DataFrame:
    """One row per object to read: links to one file (device and file id) are read once, others by path; ``n`` rows share it."""
    by_id = F.concat_ws(":", F.col("device_id").cast("string"), F.col("file_id").cast("string"))
    key = F.when(F.col("device_id").isNotNull() & F.col("file_id").isNotNull(), by_id).otherwise(F.col("path"))
    return asked.groupBy("volume", key.alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("path"))


# ---------------------------------------------------------------- the deferred queue

#: Roots, directories and bytes that wait at most; more, and the base is built again.
MAX_ROOTS, MAX_FRONTIER, MAX_QUEUE_BYTES = 4096, 100_000, 32 * 2**20


def coalesce_queue(waiting: DataFrame, new: DataFrame) -> DataFrame:
    """Work that waits, with new work: ``(volume, root, path, subtree, cursor, generation, next_attempt)``, a row per directory to list.

    Work below another's root moves into it, which keeps the least cursor, the
    greatest generation and the earliest attempt. Whether a directory is listed
    with all below stays with the directory.
    """
    rows = waiting.unionByName(new)
    roots = rows.select(F.concat(F.lit("/"), "volume", "root").alias("root")).distinct()
    least = minimal_roots(roots, "root").select(F.col("path").alias("top"))
    # The volume is the first component, so that one pass covers all volumes.
    here = rows.withColumn("_full", F.when(F.col("root") == "/", F.concat(F.lit("/"), "volume")).otherwise(F.concat(F.lit("/"), "volume", "root")))
    up = here.select("_full").distinct().select("_full", F.explode(paths.ancestors(F.col("_full"), proper=False)).alias("top"))
    cover = up.join(least, "top").select("_full", "top")
    tops = here.join(cover, "_full").withColumn("_root", F.expr("substring(top, length(volume) + 2)")).withColumn("_root", F.when(F.col("_root") == "", "/").otherwise(F.col("_root")))
    merged = tops.groupBy("volume", F.col("_root").alias("root")).agg(F.min("cursor").alias("cursor"), F.max("generation").alias("generation"), F.min("next_attempt").alias("next_attempt"))
    frontier = tops.groupBy("volume", F.col("_root").alias("root"), "path").agg(F.max("subtree").alias("subtree"))
    return frontier.join(merged, ["volume", "root"]).select("volume", "root", "path", "subtree", "cursor", "generation", "next_attempt")


def queue_state(queue: DataFrame) -> DataFrame:
    """One row: roots, directories, bytes and the least cursor that waits, and whether the queue has overflowed."""
    roots = queue.select("volume", "root").distinct().agg(F.count("*").alias("roots"), F.coalesce(F.sum(F.octet_length("root") + 128), F.lit(0)).alias("a"))
    rows = queue.agg(F.count("*").alias("directories"), F.coalesce(F.sum(F.octet_length("path") + 32), F.lit(0)).alias("b"), F.min("cursor").alias("cursor"))
    both = roots.crossJoin(rows).withColumn("bytes", (F.col("a") + F.col("b")).cast("long"))  # of one row each
    over = (F.col("roots") > MAX_ROOTS) | (F.col("directories") > MAX_FRONTIER) | (F.col("bytes") > MAX_QUEUE_BYTES)
    return both.select("roots", "directories", "bytes", "cursor", over.alias("overflow"))


def drained(queue: DataFrame, now: float, directories: int = 32) -> tuple[DataFrame, DataFrame]:
    """The next directories to list, by attempt, cursor and path, and what waits on."""
    order = [F.col("next_attempt"), F.col("cursor"), F.col("volume"), F.col("path")]
    ready = queue.where(F.col("next_attempt") <= now).orderBy(*order).limit(directories)
    key = ["volume", "root", "path"]
    return ready, queue.join(ready.select(*key), key, "left_anti")


def retried(failed: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Failed work (with ``attempts`` so far): tried again after 1, 2, 4 seconds, then a reason to build the base again."""
    tries = F.col("attempts") + 1
    return failed.withColumn("attempts", tries).withColumn("next_attempt", now + F.pow(F.lit(2.0), tries - 1)).withColumn("rebuild", tries > most)
