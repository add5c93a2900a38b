"""What the corpus operators share: the shared folder, tables that cut lineage,
batches of bounded size, word rules and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: The same in a Spark SQL (Java) pattern.
WORD_JAVA = "[^ \\t-\\r]+"

#: Texts handled at once by a Python worker, in characters; one longer text goes alone.
BATCH_CHARS = 2_000_000


#: Rows of an Arrow batch between the JVM and Python; long texts make batches of a thousand large enough.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder on a local master (tests), an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows from here on: both ends hold whole batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


# ---------------------------------------------------------------- what a Python worker keeps

T = TypeVar("T")
_KEPT: list[tuple[str, object]] = []


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def kept(owner: str, make: Callable[[], T]) -> T:
    """What ``make`` gave when ``owner`` last asked, as long as nobody else has asked since.

    A reused Python worker so holds the caches of one operator at a time.
    """
    if not _KEPT or _KEPT[0][0] != owner:
        _KEPT.clear()
        give_back()
        _KEPT.append((owner, make()))
    return _KEPT[0][1]  # type: ignore[return-value]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/canopy/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder (``exact``: to the path ``name``) and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = name if exact else new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop's file system, whatever the scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most about ``chars`` bytes of text; freed memory goes back when they end."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0)).astype(np.int64)
        at, total = 0, 0
        for i, x in enumerate(n):
            if i > at and total + x > chars:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += x
        yield b.slice(at)
    give_back()


def words_of(text: str | None) -> list[str]:
    return WORD_RE.findall(text) if text else []


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


# ---------------------------------------------------------------- components


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges in this partition, each node with its root; flushed at a bounded number of nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def flush():
        ks = list(parent)
        rs = [find(k) for k in ks]
        pairs = [(k, r) for k, r in zip(ks, rs) if k != r]
        parent.clear()
        return pa.RecordBatch.from_pydict({"u": pa.array([k for k, _ in pairs], pa.int64()), "v": pa.array([r for _, r in pairs], pa.int64())})

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                lo, hi = min(a, c), max(a, c)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 1_000_000:
            yield flush()
    yield flush()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: rows ``(node, component)`` with the smallest node id as component.

    Edges are first reduced to a spanning forest per partition, then large-star
    and small-star rounds run until nothing changes; each round is written to
    the shared folder. Hot nodes cost no more than their edges: the minimum per
    node is aggregated before the shuffle. Nodes without edges don't appear.
    """
    spark = edges.sparkSession
    home = new_dir(spark, "components")
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = table(e.mapInArrow(_local_forest, "u long, v long"), f"{home}/start", exact=True)
    last = None
    for i in range(max_rounds):
        here = f"{home}/{i:02d}"
        # large star: every larger neighbour of u points to u's least neighbour (itself included)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written, so that each join is of plain shuffles, whose hot keys AQE splits.
        low = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{here}/least", exact=True)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = table(down, f"{here}/down", exact=True)
        low = table(down.groupBy("u").agg(F.min("v").alias("m")), f"{here}/lower", exact=True)
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = table(small, f"{home}/star{i:02d}", exact=True)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        # Only this round's stars are read from here on.
        for done in (here, f"{home}/star{i - 1:02d}" if i else f"{home}/start"):
            remove_dir(spark, done)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
