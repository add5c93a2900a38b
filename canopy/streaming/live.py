"""The live path: events are planned, held against current truth and applied, and only then the cursor moves.

A micro-batch is written under its id, so one that runs again replaces itself;
the cursor is in the manifest, so a restart filters what is applied already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.engine import Engine
from canopy.functions import events as ev
from canopy.operators import changes, reconcile
from canopy.sources.work import work_table

EVENTS = "volume string, id long, path string, flags long"
#: Events of a micro-batch, and of metadata's own, beyond which history counts as lost.
INBOX, METADATA_INBOX = 100_000, 4_096
#: Look-ups of sizes and times per second.
LOOKUPS = 20_000

Listing = Callable[[DataFrame], DataFrame]


def inbox(events: DataFrame, most: int = INBOX) -> DataFrame:
    """One row: events of a micro-batch, the greatest reliable id, whether there are too many, whether history ends here."""
    ok = (F.col("id") > ev.UNRELIABLE_LOW) & (F.col("id") < ev.UNRELIABLE_HIGH)
    done = F.coalesce(F.bool_or(ev.any_of(F.col("flags"), ev.FLAGS["history_done"])), F.lit(False))
    return events.agg(F.count("*").alias("events"), F.max(F.when(ok, F.col("id"))).alias("cursor"), (F.count("*") > most).alias("overflow"), done.alias("history_done"))


def admitted(asked: DataFrame, most: int = LOOKUPS) -> DataFrame:
    """``asked(path, id)`` with ``now``: the first by id are looked up, the others wait; the cursor stays before the least id that waits (``hold``)."""
    from pyspark.sql import Window

    ranked = asked.orderBy("id", "path").limit(most).select("path", "id").withColumn("now", F.lit(True))
    out = asked.join(ranked, ["path", "id"], "left").withColumn("now", F.coalesce("now", F.lit(False)))
    return out.withColumn("hold", F.min(F.when(~F.col("now"), F.col("id") - 1)).over(Window.partitionBy()))  # of one micro-batch


def recovery_wait(failures: Column) -> Column:
    """Seconds until a recovery is tried again, null once it has failed eight times: then it waits for a user."""
    return F.when(failures < 8, F.least(F.lit(300), F.pow(F.lit(2), F.least(failures, F.lit(8))).cast("int")))


def take(engine: Engine, events: DataFrame, batch_id: int, listing: Listing) -> str:
    """Apply one micro-batch of ``events``; what became of it: applied, empty, or rebuild (nothing is applied and the cursor stays).

    ``listing(base)`` gives the rows that are there now, in the base's columns.
    """
    m = engine.store.manifest()
    events = changes.after_floor(events, m.cursor)
    state = inbox(events).first()
    if not state.events:
        return "empty"
    # Read from the source until it is known that they are few; then stored, as each rule reads them.
    if state.overflow or not events.where(ev.classify(F.col("flags")) == "invalidated").isEmpty():
        engine.state = "rebuilding"
        return "rebuild"
    events = work_table(events, "inbox")
    base = engine._all_rows()
    actual = listing(base).select(*base.columns)
    mutations = None
    for volume in [r.volume for r in events.select("volume").distinct().collect()]:  # mounted volumes
        own = events.where(F.col("volume") == volume).drop("volume")
        plan = changes.plan_batch(own)
        name = lambda df, v=volume: df.withColumn("volume", F.lit(v))
        here, there = base.where(F.col("volume") == volume), actual.where(F.col("volume") == volume)
        patches, dirty = reconcile.authoritative(name(plan["patches"].select("path")), there)
        listed = work_table(reconcile.reconcile(here, there, name(plan["scopes"]).select("volume", "root", "subtree").unionByName(dirty)), "listed")
        both = listed.unionByName(patches.join(listed.select("volume", "path").distinct(), ["volume", "path"], "left_anti"))
        mutations = both if mutations is None else mutations.unionByName(both)
    engine.apply(mutations.select("op", "seq", *base.columns), f"b{batch_id:012d}")
    # Only now: had the process ended before, the batch would run again.
    engine.store.checkpoint(max(m.cursor, state.cursor or 0), m.metadata_cursor)
    engine.state = "live" if state.history_done or engine.state == "live" else "catching_up"
    return "applied"


def follow(engine: Engine, source: str, checkpoint: str, listing: Listing, recover: Callable[[Engine], None], max_files: int = 100, once: bool = True) -> StreamingQuery:
    """Follow Parquet files of events; ``recover(engine)`` builds the base again when history is lost."""

    def write(df: DataFrame, batch_id: int) -> None:
        if take(engine, df, batch_id, listing) == "rebuild":
            recover(engine)

    stream = engine.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=engine.config.trigger)).start()
