"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import decontaminate, mixing, neardup, repeats, wavelet
from canopy.llm.common import new_dir, remove_dir, small_batches, table
from canopy.llm.queries import read, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or the repetition rules go.

    Null, empty and blank texts fail; equal rows stay or go together; ids play
    no part; other columns of any name stay; an empty table gives an empty one.
    """
    small_batches(spark)
    return repeats.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the least id stays.

    Rows without id or words stay; rows of one id are one document and stay or
    go together; an empty table gives an empty one.
    """
    return neardup.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and blank texts and items match nothing; of rows with one id those go
    whose own text has an item; an empty table on either side takes nothing.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped as their source's rate asks.

    A null source is a source; texts without words have size 0, and so their
    source's rate decides; rows equal in id and text draw alike; an empty table
    gives an empty one.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in wavelet shards; the result is read back from the files.

    A null or empty text has the end id alone; null ids come first; equal rows
    are written one by one; an empty table writes no file and gives no row.
    """
    return wavelet.read_digests(wavelet.write_shards(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("token output", token_output),
]

#: Token ids and MinHash groups have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_dir(spark, "stage")
        docs = table(stage(spark, docs, sf_dir), path, exact=True)
        if last:
            remove_dir(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
