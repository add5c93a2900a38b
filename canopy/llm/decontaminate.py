"""Benchmark decontamination with DataFrame operations only.

Windows of a document as long as a benchmark item are fingerprinted with a
64-bit SimHash over word shingles. Fingerprints are indexed by blocks of bits:
two that differ in at most ``radius`` bits agree on one of ``radius + 1``
blocks, so equality of a block finds all of them. Candidates within the radius
are verified by the exact similarity of their shingles.

Which windows can match is decided exactly, before any is fingerprinted:

* A window may slide on by a word without loss while its first shingle has no
  partner in the item, up to the text's end. So the windows that start at a
  shingle of an item of that length, and the last window, are all that count.
* A window of m' shingles, c of them with partners among an item's m, is
  similar to ``percent`` only if c >= m' - m * (100 - percent) / percent, by
  weights as by counts. Windows with fewer shingles of items of that length are
  out.

Blocks of a few bits part unlike fingerprints badly at such a radius, so the
shingle at which a window starts is part of the index's key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import bounded_broadcast, table

#: Benchmark shingles, and documents with one, are broadcast up to so many rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Match:
    #: Words of a shingle; items with fewer words are one shingle.
    words: int = 5
    #: Least similarity in hundredths, weighted or plain.
    percent: int = 80
    #: A pair of similarity 0.8 differs in at most 10 of 64 bits on average and in over 20 with probability 1e-4.
    radius: int = 20


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only) as an array; null for a null text."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[ \\t-\\r]+"), lambda w: w != "")


def shingled(df: DataFrame, size: int, first: Column, last: Column) -> DataFrame:
    """``df`` without its words ``ws``, a row per shingle of ``size`` words that starts at a place from ``first`` to ``last``: ``at`` and the hash ``h``.

    Exploding places, not shingles, keeps all of it in generated code.
    """
    others = [c for c in df.columns if c != "ws"]
    places = df.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("at"))
    return places.select(*others, "at", F.xxhash64(*[F.get("ws", F.col("at") + j) for j in range(size)]).alias("h"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that share out 64 bits."""
    n = radius + 1
    edge = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def block_values(fingerprint: Column, radius: int) -> Column:
    """An array of block values, each with its block's number in it."""
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b) - 1)) * 64 + i for i, (a, b) in enumerate(_blocks(radius))])


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """Two SimHashes of ``rows(h, w, c)`` per group, by weights (``plain`` is false) and by counts.

    Votes are the roots of weight times count, so that the cosine of two
    windows is at least what they share over the mean of what they hold.
    """
    by = [*by, "plain"]
    rows = rows.withColumn("plain", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = rows.withColumn("vote", F.floor(F.sqrt(F.when(F.col("plain"), F.lit(1000)).otherwise(F.col("w")) * F.col("c") * F.lit(1000))).cast("long"))
    bit = lambda b: F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("vote")).otherwise(-F.col("vote")))
    votes = rows.groupBy(*by).agg(*[bit(b).alias(f"b{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return votes.select(*by, value.alias("fingerprint"))


def benchmark_index(bench: DataFrame, m: Match) -> tuple[DataFrame, DataFrame]:
    """Items (item, n, k, plain, fingerprint) and their distinct shingles (item, n, k, h, w, ci, weight).

    ``k`` is the shingle size of the item, ``ci`` the shingle's count in it and
    ``weight`` the item's in all. A shingle's weight in thousandths falls with
    the number of items that have it. Null and blank items don't appear; equal
    ids are told apart by their text.
    """
    base = bench.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("ws")).where("size(ws) > 0").dropDuplicates()
    base = base.select(F.struct("item_id", F.xxhash64("ws").alias("tie")).alias("item"), F.size("ws").alias("n"), F.least(F.size("ws"), F.lit(m.words)).alias("k"), "ws")
    by_size = None
    for k in range(1, m.words + 1):
        part = shingled(base.where(F.col("k") == k), k, F.lit(0), F.col("n") - k)
        by_size = part if by_size is None else by_size.unionByName(part)
    rows = table(by_size.groupBy("item", "n", "k", "h").agg(F.count("*").alias("ci")), "benchmark")
    df = rows.groupBy("h").agg(F.count("*").alias("df"))
    rows = rows.join(df, "h").select("item", "n", "k", "h", weight(F.col("df")).alias("w"), "ci")
    total = rows.groupBy("item").agg(F.sum(F.col("w") * F.col("ci")).alias("weight"))
    rows = table(rows.join(total, "item"), "benchmark")
    return table(fingerprints(rows.withColumnRenamed("ci", "c"), ["item", "n", "k"]), "items"), rows


def weight(df: Column) -> Column:
    """A shingle's weight in thousandths: full in one item, less the more items have it."""
    return F.greatest(F.lit(1), F.floor(F.lit(1000.0) / F.greatest(df, F.lit(1)))).cast("long")


def candidate_windows(texts: DataFrame, shingle_rows: DataFrame, sizes: list[int], m: Match) -> DataFrame:
    """Windows of ``texts(doc_id, tie, ws)`` that may match an item: doc_id, tie, k, n, start, and ``h``, an item's shingle in it.

    ``start`` is the shingle's place, or the last window's start if that is less.
    """
    hit = None
    for k in sizes:
        keys = bounded_broadcast(shingle_rows.where(F.col("k") == k).select("n", "h").distinct(), BROADCAST_ROWS)
        found = shingled(texts.select("doc_id", "tie", F.size("ws").alias("len"), "ws"), k, F.lit(0), F.col("len") - k).join(keys, "h")
        found = found.select("doc_id", "tie", "len", F.lit(k).alias("k"), "n", "at", "h")
        hit = found if hit is None else hit.unionByName(found)
    # A list per text and item length, as bounded as the text; equal rows give one set.
    seeds = hit.groupBy("doc_id", "tie", "len", "k", "n").agg(F.array_sort(F.collect_set(F.struct("at", "h"))).alias("seeds"))
    inside = (F.least("len", "n") - F.col("k") + 1).alias("inside")
    spare = F.floor((F.col("n") - F.col("k") + 1) * (100 - m.percent) / F.lit(m.percent)).cast("int")
    seeds = seeds.select("*", inside).withColumn("need", F.greatest(F.lit(1), F.col("inside") - spare)).where("size(seeds) >= need")
    last = F.greatest(F.lit(0), F.col("len") - F.col("n"))
    windows = seeds.select("*", F.posexplode("seeds").alias("j", "seed")).withColumn("start", F.least(F.col("seed.at"), last))
    # The need-th shingle from the start on lies in the window; the last window ends with the text.
    ahead = F.get("seeds", F.col("j") + F.col("need") - 1)["at"] <= F.col("start") + F.col("inside") - 1
    at_end = F.get("seeds", F.size("seeds") - F.col("need"))["at"] >= F.col("start")
    enough = F.when(F.col("seed.at") <= last, ahead).otherwise(at_end)
    return windows.where(F.coalesce(enough, F.lit(False))).select("doc_id", "tie", "k", "n", "start", F.col("seed.h").alias("h"))


def leaks(docs: DataFrame, bench: DataFrame, m: Match = Match()) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start, n_words, hamming, similarity.

    ``similarity`` is the greater of the plain one, c / (m + m' - c), and the
    weighted one, in which partners count by their weight and shingles of the
    window without partner as much as the item's do on average. ``hamming`` is
    the lesser distance of the two fingerprints. ``start`` is the best window's
    first word, from 0. Documents shorter than an item are one window. Null,
    empty and blank texts and items match nothing; rows of one id (or null ids)
    are told apart by their text's hash, and equal rows give one row. Of equal
    similarities the lesser distance, then the earlier window is named. An empty
    table on either side gives no rows.
    """
    items, shingle_rows = benchmark_index(bench, m)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), words(F.col("text").cast("string")).alias("ws"))
    sizes = [r.k for r in items.select("k").distinct().collect()]  # at most m.words
    if not sizes:
        return docs.sparkSession.createDataFrame([], LEAKS)
    seeds = table(candidate_windows(texts, shingle_rows, sizes, m), "windows")
    per = seeds.select("doc_id", "tie", "k", "n", "start").distinct().groupBy("doc_id", "tie").agg(F.collect_list(F.struct("k", "n", "start")).alias("windows"))  # as bounded as the text
    per = table(per, "windows").select(F.col("doc_id").alias("w_id"), F.col("tie").alias("w_tie"), "windows")
    # Only ids are broadcast, and only up to a number of them; the windows meet their texts in a shuffle.
    same = texts["doc_id"].eqNullSafe(F.col("w_id")) & (texts["tie"] == F.col("w_tie"))
    at = texts.join(bounded_broadcast(per.select("w_id", "w_tie"), BROADCAST_ROWS), same, "left_semi")
    at = at.join(per, at["doc_id"].eqNullSafe(per["w_id"]) & (at["tie"] == per["w_tie"])).select("doc_id", "tie", "ws", F.explode("windows").alias("v"))
    at = at.dropDuplicates(["doc_id", "tie", "v"])  # equal rows
    key = ["doc_id", "tie", "k", "n", "start"]
    at = at.select("doc_id", "tie", "v.*", F.size("ws").alias("len"), "ws")
    parts = None
    for k in sizes:
        last = F.least(F.col("start") + F.col("n"), F.col("len")) - k
        cut = shingled(at.where(F.col("k") == k), k, F.col("start"), last)
        parts = cut if parts is None else parts.unionByName(cut)
    known = bounded_broadcast(shingle_rows.select("h", F.col("w").alias("w1")).distinct(), BROADCAST_ROWS)
    parts = parts.groupBy(*key, "h").agg(F.count("*").alias("c")).join(known, "h", "left")
    mean = F.greatest(F.lit(1), F.floor(F.avg("w1").over(Window.partitionBy(*key)))).cast("long")
    parts = table(parts.select(*key, "h", "c", F.coalesce("w1", mean).alias("w")), "shingles")
    prints = table(fingerprints(parts, key), "fingerprints")

    # The index: an item's fingerprint under each of its shingles that starts a window, block by block.
    asked = bounded_broadcast(seeds.select("n", "k", "h").distinct(), BROADCAST_ROWS)
    blocks = F.explode(block_values(F.col("fingerprint"), m.radius)).alias("block")
    right = shingle_rows.select("item", "n", "k", "h").join(asked, ["n", "k", "h"], "left_semi").join(items, ["item", "n", "k"])
    right = right.select("item", "n", "k", "h", "plain", F.col("fingerprint").alias("item_fingerprint"), blocks)
    found = seeds.distinct().join(prints.select(*[F.col(c).alias(f"p_{c}") for c in key], "plain", "fingerprint"), [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in key])
    left = found.select(*key, "h", "plain", "fingerprint", blocks)
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    close = left.join(right, ["n", "k", "h", "plain", "block"]).withColumn("hamming", distance).where(F.col("hamming") <= m.radius)
    close = close.groupBy(*key, "item").agg(F.min("hamming").alias("hamming"))

    pairs = close.join(parts.select(*[F.col(c).alias(f"p_{c}") for c in key], F.col("h"), "c"), [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in key]).drop(*[f"p_{c}" for c in key])
    pairs = pairs.withColumn("held", F.sum("c").over(Window.partitionBy(*key, "item")))
    shared = F.least("c", "ci")
    both = pairs.join(shingle_rows.select("item", "h", "w", "ci", "weight"), ["item", "h"]).groupBy(*key, "item", "hamming", "held", "weight").agg(F.sum(F.col("w") * shared).alias("both"), F.sum(shared).alias("same"))
    own = F.col("n") - F.col("k") + 1
    either = own + F.col("held") - F.col("same")
    good = both.where((100 * F.col("same") >= m.percent * either) | (100 * F.col("both") * own >= m.percent * F.col("weight") * either))
    good = good.withColumn("similarity", F.greatest(F.col("same") / either, (F.col("both") * own) / (F.col("weight") * either)))
    best = good.groupBy("doc_id", "tie", "item").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("near"), (-F.col("start")).alias("early"), "n")).alias("b"))
    return best.select("doc_id", F.col("item.item_id").alias("item_id"), (-F.col("b.early")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"), (-F.col("b.near")).cast("long").alias("hamming"), F.col("b.similarity").alias("similarity"), "tie")


LEAKS = "doc_id long, item_id long, start long, n_words long, hamming long, similarity double, tie long"


def keep_clean(docs: DataFrame, bench: DataFrame, m: Match = Match()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Null and blank texts stay; of rows with one id, those go whose own text has
    an item; equal rows stay or go together; an empty table gives an empty one.
    """
    # Written first: the rows with leaks are few beside the documents.
    bad = table(leaks(docs, bench, m).select(F.col("doc_id").alias("bad_id"), F.col("tie").alias("bad_tie")).distinct(), "leaks")
    bad = bounded_broadcast(bad, BROADCAST_ROWS)
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_tie"])
    return docs.join(bad, same, "left_anti")
