"""The change stream: files of events in, overlay batches out.

Each micro-batch is classified, held against the replay floors, coalesced and
written under its batch id, so a batch that runs again replaces itself. The
cursor of a batch is its greatest reliable id; a reader resumes from the least
of the namespace and metadata cursors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.functions import events as ev
from canopy.operators import changes

EVENTS = "id long, path string, flags long"
BATCH = "path string, flags long, id long, n long, class string, impact string, batch_id long"


def process(events: DataFrame, batch_id: int, name_floor: int = 0, metadata_floor: int = 0) -> DataFrame:
    """Coalesced changes with what they mean for names and for sizes and times.

    The two floors are apart: an event that names have seen may be new to
    metadata; its class is then null, and the other way round.
    """
    least = min(name_floor, metadata_floor)
    rows = changes.after_floor(events, least)
    merged = changes.coalesced(rows)
    seen = lambda floor: ev.is_replayed(F.col("flags"), F.col("id"), floor)
    return merged.select(
        "path",
        "flags",
        "id",
        "n",
        F.when(~seen(name_floor), ev.classify(F.col("flags"))).alias("class"),
        F.when(~seen(metadata_floor), ev.impact(F.col("flags"))).alias("impact"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    )


def run(spark: SparkSession, source: str, out: str, checkpoint: str, name_floor: int = 0, metadata_floor: int = 0, max_files: int = 100, once: bool = True) -> StreamingQuery:
    """Start the stream over Parquet files of events; ``once`` drains what is there, else it goes on every 200 ms."""

    def write(df: DataFrame, batch_id: int) -> None:
        # One folder per batch: overwriting it makes a repeated batch harmless.
        process(df, batch_id, name_floor, metadata_floor).drop("batch_id").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()


def applied(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(BATCH).parquet(out)


def cursor(spark: SparkSession, out: str) -> int:
    """The greatest reliable id of all finished batches; 0 before the first."""
    row = changes.next_cursor(applied(spark, out)).first()
    return row.cursor or 0
