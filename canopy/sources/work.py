"""Work folders and tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is sent to every task.
SMALL = 1_000_000
#: Bits of ``Marks``: 8 MB whatever the number of keys.
MARKS = 2**26
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a temporary folder on a local master (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def work_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written and read back: lineage ends here, and a lost executor loses nothing."""
    path = work_dir(df.sparkSession, name)
    with tidy(df.sparkSession):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it has few rows; they are counted, so it should be a work table."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


class Marks:
    """A bit per hash of the keys of a table, to tell rows of a much larger one that surely have none of them.

    A join on the key need move only the others: the keys' own rows and, of the
    rest, one in ``MARKS`` / keys by chance.
    """

    def __init__(self, keys: DataFrame, on: list[str]):
        self.on = on
        slot = self._slot()
        blocks = keys.select(F.bitmap_bucket_number(slot).alias("_block"), F.bitmap_bit_position(slot).alias("_bit"))
        self.blocks = work_table(blocks.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "marks")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.on), F.lit(MARKS)) + 1

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that may have one of the keys, and those that have none."""
        bit = F.bitmap_bit_position(self._slot())
        byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # At most MARKS / 32,768 blocks of 4 KB.
        marked = rows.withColumn("_block", F.bitmap_bucket_number(self._slot())).join(F.broadcast(self.blocks), "_block", "left")
        marked = marked.withColumn("_marked", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
        return marked.where("_marked").select(*rows.columns), marked.where("NOT _marked").select(*rows.columns)
