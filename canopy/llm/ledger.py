"""Token counts as delta-maintained rollups.

Changes to documents become signed rows (an insert adds, a delete subtracts, a
revision does both) that are summed by source, language and tokenizer version
before they are stored, so a batch is a few rows however large it was. A batch
is committed by one rename; committing it again changes nothing. Totals are the
sum of all batches, or of a compacted base and the batches after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import kept, slices

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"


def _counted(ranks_path: str, pattern: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks_path, pattern)
        for b in slices(batches):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    return run


def _encoding(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    def load():
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return kept(f"ranks {ranks_path}", load)


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens for each row; null and empty texts have 0 tokens.

    Rows are counted one by one, equal rows each; a null source or language is
    a key of its own; an empty table gives no rows.
    """
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("text", "string"))))
    counted = rows.mapInArrow(_counted(ranks_path, pattern), "doc_id long, source string, lang string, n_tokens long")
    return counted.withColumn("tokenizer", F.lit(tokenizer))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows that add each counted document."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take each document away with the count it had."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).cast("long").alias("d_tokens"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows from one state of counted documents to another; documents that are the same in both cancel out."""
    return deletes(old).unionByName(inserts(new))


class Ledger:
    """Committed batches under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)

    def _rename(self, a: str, b: str) -> None:
        """Fails if ``b`` is there: of two writers one wins."""
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        self._context.rename(self._path(a), self._path(b), none)

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def commit(self, batch_id: int, signed: DataFrame) -> bool:
        """Add a batch; False, and nothing done, if it is there already. An id at or below the base that was never committed raises."""
        if batch_id < 0:
            raise ValueError("batch ids start at 0")
        if self._exists(self._batch(batch_id)):  # compaction leaves the batches that the base holds
            return False
        if batch_id <= self._base():
            raise ValueError(f"batch {batch_id} was never committed, and later ones are compacted already")
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        # Summed in each task before the shuffle; a hot source is a row per task.
        delta = signed.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        delta.where("d_docs <> 0 OR d_tokens <> 0").coalesce(1).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.path}/batches"))
        try:
            self._rename(staged, self._batch(batch_id))
        except Exception:
            self._fs.delete(self._path(staged), True)
            if self._exists(self._batch(batch_id)):
                return False
            raise
        return True

    def _batch(self, batch_id: int) -> str:
        return f"{self.path}/batches/{batch_id:012d}"

    def _names(self, folder: str) -> list[int]:
        if not self._exists(f"{self.path}/{folder}"):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))

    def _base(self) -> int:
        return max(self._names("bases"), default=-1)

    def batches(self) -> list[int]:
        """Batches that aren't in the base."""
        base = self._base()
        return [b for b in self._names("batches") if b > base]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose counts are back at 0 don't appear."""
        base = self._base()
        paths = [self._batch(b) for b in self.batches()] + ([f"{self.path}/bases/{base:012d}"] if base >= 0 else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        out = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all batches so far into a new base; totals stay the same at every moment. Batches must be committed in ascending order."""
        found = self.batches()
        if not found:
            return
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        self.totals().select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens")).coalesce(1).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.path}/bases"))
        self._rename(staged, f"{self.path}/bases/{found[-1]:012d}")
