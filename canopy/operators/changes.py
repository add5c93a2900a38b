"""A batch of change events to mutations and dirty scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import events as ev
from canopy.functions import paths
from canopy.operators.tree import minimal_roots, outside
from canopy.sources.work import work_table

STORM = 256
COLLAPSE = 512


def coalesced(events: DataFrame) -> DataFrame:
    """One row per path: flags united, the greatest id, the number of events."""
    return events.groupBy("path").agg(F.bit_or("flags").alias("flags"), F.max("id").alias("id"), F.count("*").alias("n"))


def after_floor(events: DataFrame, floor: int) -> DataFrame:
    """Without what a replay has brought before."""
    return events.where(~ev.is_replayed(F.col("flags"), F.col("id"), floor))


def conflicting(events: DataFrame) -> DataFrame:
    """Paths that were created and removed in one batch: only a listing of the parent tells."""
    both = ev.bits("created", "removed")
    seen = events.groupBy("path").agg(F.bit_or(F.col("flags").bitwiseAND(F.lit(both).cast("long"))).alias("seen"))
    return seen.where(F.col("seen") == both).select("path", paths.parent(F.col("path")).alias("parent"))


def dirty_parents(events: DataFrame, most: int = COLLAPSE) -> DataFrame:
    """Parents with the number of changed children; ``collapse`` where a listing is cheaper than look-ups."""
    per = events.select("path").distinct().groupBy(paths.parent(F.col("path")).alias("parent")).agg(F.count("*").alias("children"))
    return per.withColumn("collapse", F.col("children") >= most)


def plan_batch(events: DataFrame, floor: int = 0, storm: int = STORM) -> dict[str, DataFrame]:
    """Direct patches, dirty scopes and lost-history marks of a batch.

    * ``rebuild``: events that say history is lost.
    * ``scopes``: minimal roots to list again; ``subtree`` roots with all below.
    * ``patches``: creates and removes outside all scopes, hints to be held
      against current truth. In a storm there are none, only parents.
    """
    # Written, as a batch is read by each of the rules below.
    rows = work_table(after_floor(events, floor).withColumn("class", ev.classify(F.col("flags"))), "batch")
    rebuild = rows.where("class = 'invalidated'")
    parent = paths.parent(F.col("path"))
    subtree = rows.where("class = 'subtree_dirty'").select(F.col("path").alias("root"))
    unclear = rows.where("class = 'ambiguous'").select(parent.alias("root"))
    clash = conflicting(rows).select(F.col("parent").alias("root"))
    simple = rows.where(F.col("class").startswith("simple_"))
    removed = simple.where("class = 'simple_remove'").select(F.col("path").alias("removed")).distinct()
    # A child that is created under a removed directory: the order is unknown, so the directory's parent is listed.
    up = simple.where("class <> 'simple_remove'").select("path", F.explode(paths.ancestors(F.col("path"))).alias("removed"))
    stale = up.join(removed, "removed", "left_semi").select(paths.parent(F.col("removed")).alias("root"))
    names = simple.unionByName(rows.where("class = 'ambiguous'"))
    roots = subtree.unionByName(unclear).unionByName(clash).unionByName(stale)
    if names.limit(storm + 1).count() > storm:
        roots = roots.unionByName(simple.select(parent.alias("root")))
    scopes = work_table(minimal_roots(work_table(roots.distinct(), "roots"), "root").select(F.col("path").alias("root")), "scopes")
    scopes = scopes.join(subtree.distinct().withColumn("subtree", F.lit(True)), "root", "left").withColumn("subtree", F.coalesce("subtree", F.lit(False)))
    patches = outside(simple.withColumn("_scope", parent), scopes.select("root"), "_scope").drop("_scope")
    patches = patches.groupBy("path").agg(F.max_by("class", "id").alias("class"), F.max("id").alias("id"))
    return {"rebuild": rebuild, "scopes": scopes, "patches": patches}


def next_cursor(events: DataFrame) -> DataFrame:
    """The greatest reliable id."""
    ok = (F.col("id") > ev.UNRELIABLE_LOW) & (F.col("id") < ev.UNRELIABLE_HIGH)
    return events.agg(F.max(F.when(ok, F.col("id"))).alias("cursor"))
