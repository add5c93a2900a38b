"""Counts, layout, percentiles, volume rollups, gates and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_stats(entries: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """One row per volume: live, files, directories, links."""
    live = entries if tombstones is None else entries.join(tombstones.select("volume", "path"), ["volume", "path"], "left_anti")
    return live.groupBy("volume").agg(
        F.count("*").alias("live"),
        F.count_if(F.col("kind") == "file").alias("files"),
        F.count_if(F.col("kind") == "directory").alias("directories"),
        F.count_if(F.col("kind") == "symlink").alias("symlinks"),
    )


def layout_stats(entries: DataFrame) -> DataFrame:
    same = F.col("name") == F.col("folded")
    return entries.groupBy("volume").agg(
        F.count_if(same).alias("same_rows"),
        F.sum(F.when(same, F.octet_length("name")).otherwise(0)).cast("long").alias("same_bytes"),
        F.sum(F.octet_length("name")).cast("long").alias("name_bytes"),
        F.sum(F.octet_length("folded")).cast("long").alias("folded_bytes"),
    )


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(f * n), with least and greatest."""
    cells = [F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, f in fractions.items()]
    return df.groupBy(*by).agg(F.min(value).alias("least"), *cells, F.max(value).alias("most"))


def volume_rollup(volumes: DataFrame) -> DataFrame:
    """One row over ``volumes(volume, state, metadata_complete)``."""
    return volumes.agg(
        F.count_if(F.col("state") == "live").alias("searched"),
        F.count_if(F.col("state") == "catching_up").alias("catching_up"),
        F.count_if(F.col("state") == "offline").alias("offline"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == "failed", F.col("volume")))), ",").alias("failed"),
        F.bool_and("metadata_complete").alias("metadata_complete"),
    )


def read_failures(failures: DataFrame) -> DataFrame:
    """Per volume that isn't offline: total, permission, dataless and other failures."""
    sums = failures.where("NOT offline").groupBy("volume").agg(F.sum("total").alias("total"), F.sum("permission").alias("permission"), F.sum("dataless").alias("dataless"))
    return sums.withColumn("other", F.greatest(F.lit(0), F.col("total") - F.col("permission") - F.col("dataless")))


def growing_backlog(samples: DataFrame, n: int = 12) -> DataFrame:
    """Marks samples whose last ``n`` values never fall and end above where they began."""
    w = Window.partitionBy("series").orderBy("at")
    steps = samples.withColumn("_up", F.coalesce(F.col("value") >= F.lag("value").over(w), F.lit(True)))
    last = w.rowsBetween(-(n - 1), 0)
    inner = w.rowsBetween(-(n - 2), 0)
    grows = (F.count("*").over(last) == n) & F.bool_and("_up").over(inner) & (F.col("value") > F.first("value").over(last))
    return steps.withColumn("growing", grows).drop("_up")


def quiet(samples: DataFrame, seconds: int = 30) -> DataFrame:
    """Marks samples with no blocker and no change of ``generation`` for that long."""
    w = Window.partitionBy("series").orderBy("at")
    changed = F.coalesce(F.col("generation") != F.lag("generation").over(w), F.lit(True)) | F.col("blocked")
    marked = samples.withColumn("_since", F.when(changed, F.col("at")))
    since = F.max("_since").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("quiet", F.col("at") - since >= seconds).drop("_since")


def idle_average(samples: DataFrame, alpha: float = 0.4) -> DataFrame:
    """Exponentially weighted average of each series' values in order; a series is bounded by its source's window."""
    listed = samples.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    step = F.aggregate("v", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["value"]).otherwise(acc * (1 - alpha) + x["value"] * alpha))
    return listed.select("series", step.alias("average"))


def maintenance_order(jobs: DataFrame) -> DataFrame:
    """``place`` of each waiting job: urgency, then priority, then first come."""
    w = Window.orderBy(F.col("urgency").desc(), F.col("priority").desc(), F.col("arrival").asc())
    return jobs.withColumn("place", F.row_number().over(w))  # a queue of waiting jobs, not data


def table_digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))


def page_digest(hits: DataFrame) -> DataFrame:
    """SHA-256 of an ordered page's path, size and time, to compare a result before and after a move."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "path", "size", "mtime")))
    return hits.agg(F.sha2(F.to_json(rows), 256).alias("digest"))
