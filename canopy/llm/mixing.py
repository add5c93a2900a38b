"""Mixing sources to target weights with DataFrame operations only.

Every document is emitted ``floor(rate)`` times plus one Bernoulli copy, seeded
by a hash of its id and text, whose probability is the rate's fraction; the rate of a
source is its target size over its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import WORD_JAVA, bounded_broadcast, table

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No target exceeds so many times its source's size.
MAX_EPOCHS = 3
#: Source tables of at most so many rows are broadcast; larger ones are joined by a shuffle that AQE splits.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words in a text as a long; null and blank texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of ``sized(source, size)``: source, source_size, weight, target.

    Targets share the total by weight; those above ``max_epochs`` times their
    source stop there and their excess is shared anew by weight until none is
    above. In the order of size over weight the stopped sources come first, so
    running sums find that fixed point at once. All sums are exact integers.
    A null source is a source of its own; an empty table gives no row.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * F.lit(int(max_epochs)))
    common = 1
    for w in weights:
        common *= w
    per = per.withColumn("order", F.col("source_size") * (F.lit(common) / F.col("weight")).cast("long"))
    run = Window.orderBy("order", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    per = per.withColumn("left", F.sum("source_size").over(whole) - F.sum("cap").over(run) + F.col("cap"))
    per = per.withColumn("left_weight", F.sum("weight").over(whole) - F.sum("weight").over(run) + F.col("weight"))
    # A source is stopped if its share of what its forerunners leave is above its cap.
    above = F.col("weight").cast("decimal(38,0)") * F.col("left") > F.col("cap").cast("decimal(38,0)") * F.col("left_weight")
    per = per.withColumn("stopped", above)
    rest = F.sum(F.col("source_size") - F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(whole)
    rest_weight = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / rest_weight.cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id, text and seed alone: 48 bits of an MD5 digest."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def copies(source_size: Column, target: Column, draw: Column) -> Column:
    """``floor(rate)`` copies, and one more if the draw is below the rate's fraction; none of a source without words."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def planned(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of ``docs``.

    Words are counted once: what the plan needs of each row is written without
    its text. Null or empty texts have size 0; a source of size 0 has target 0
    and its documents get no copy. Rows equal in id and text draw the same
    number. An empty table gives no rows.
    """
    rows = table(docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), uniform(docs["doc_id"], docs["text"], seed).alias("draw")), "sizes")
    per = table(source_targets(rows, weights, max_epochs), "targets").withColumnRenamed("source", "named")
    out = rows.join(bounded_broadcast(per, BROADCAST_SOURCES), rows["source"].eqNullSafe(per["named"]))
    out = out.withColumn("copies", copies(F.col("source_size"), F.col("target"), F.col("draw")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as planned, with its columns unchanged, whatever their names.

    Draws and rates are those of ``planned``. A row that is taken more than once
    stands there as equal rows. An empty table gives an empty one.
    """
    per = table(source_targets(docs.select("source", n_words(docs["text"]).alias("size")), weights, max_epochs), "targets")
    named, total, target, copy = (free_name(docs, x) for x in ("named", "total", "target", "copy"))
    per = per.select(F.col("source").alias(named), F.col("source_size").alias(total), F.col("target").alias(target))
    out = docs.join(bounded_broadcast(per, BROADCAST_SOURCES), docs["source"].eqNullSafe(per[named]))
    n = copies(F.col(total), F.col(target), uniform(docs["doc_id"], docs["text"], seed))
    return out.withColumn(copy, n).where(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
