"""Structural rules of a base as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import paths
from canopy.functions.text import with_folded
from canopy.sources.work import Marks

KINDS = ("file", "directory", "symlink", "other")
#: Bytes of a name and of a path: the platform's limits.
NAME_MAX, PATH_MAX = 255, 1024


def repeated(rows: DataFrame) -> DataFrame:
    """(volume, path) that stand there more than once. Hashes tell which rows to compare, so a sound table's paths aren't shuffled."""
    keyed = rows.select("volume", "path", F.xxhash64("volume", "path").alias("_key"))
    again = keyed.select("_key").repartition("_key").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1")
    return Marks(again, ["_key"]).split(keyed)[0].groupBy("volume", "path").agg(F.count("*").alias("n")).where("n > 1").select("volume", "path")


def violations(entries: DataFrame, whole: bool = True) -> DataFrame:
    """volume, path, why for each rule that an entry breaks; a sound base gives no row.

    Rules: a normal path within the limits; a known kind; name and parent are
    those of the path; the folded name is the name's; no path twice; the parent
    is there and is a directory; every volume has its root. Not ``whole``, the
    table may hold part of a tree, and the last two rules don't count.
    """
    path = F.col("path")
    own = entries.select("volume", "path", "parent", "name", "folded", "kind")
    rules = [
        (~paths.normalize(path).eqNullSafe(path), "path"),
        ((F.octet_length("name") > NAME_MAX) | (F.octet_length("path") >= PATH_MAX), "length"),
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind"),
        (~F.col("name").eqNullSafe(paths.basename(path)), "name"),
        (~F.col("parent").eqNullSafe(paths.parent(path)), "parent"),
        ((path == "/") & (F.col("kind") != "directory"), "root"),
    ]
    whys = F.array_compact(F.array(*[F.when(rule, F.lit(why)) for rule, why in rules]))
    alone = own.select("volume", "path", F.explode(whys).alias("why"))
    wrong_fold = with_folded(own, "name", "_f").where(~F.col("folded").eqNullSafe(F.col("_f"))).select("volume", "path", F.lit("fold").alias("why"))
    inner = alone.unionByName(wrong_fold).unionByName(repeated(own).withColumn("why", F.lit("twice")))
    if not whole:
        return inner
    folders = own.where("kind = 'directory'").select("volume", path.alias("parent")).distinct()
    orphans = own.where("path <> '/'").join(folders, ["volume", "parent"], "left_anti").select("volume", "path", F.lit("orphan").alias("why"))
    rootless = own.select("volume").distinct().join(own.where("path = '/'").select("volume"), "volume", "left_anti").select("volume", F.lit("/").alias("path"), F.lit("no_root").alias("why"))
    return inner.unionByName(orphans).unionByName(rootless)


def numbering_violations(numbered: DataFrame) -> DataFrame:
    """volume, ordinal, why where preorder numbers are unsound: gaps, a child outside its parent's range, a wrong number of children, a leaf with a range."""
    n = numbered.select("volume", "path", "parent", "ordinal", "subtree_end", "child_count")
    per = n.groupBy("volume").agg(F.count("*").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d"))
    gaps = per.where("lo <> 0 OR hi <> n - 1 OR d <> n").select("volume", F.lit(-1).cast("long").alias("ordinal"), F.lit("gaps").alias("why"))
    up = n.select("volume", F.col("path").alias("parent"), F.col("ordinal").alias("p"), F.col("subtree_end").alias("end"))
    nested = n.where("path <> '/'").join(up, ["volume", "parent"]).where("ordinal <= p OR subtree_end > end").select("volume", "ordinal", F.lit("nesting").alias("why"))
    kids = n.where("path <> '/'").groupBy("volume", F.col("parent").alias("path")).agg(F.count("*").alias("k"))
    counts = n.join(kids, ["volume", "path"], "left").where("child_count <> coalesce(k, 0)").select("volume", "ordinal", F.lit("children").alias("why"))
    leaves = n.where("child_count = 0 AND subtree_end <> ordinal + 1").select("volume", "ordinal", F.lit("leaf").alias("why"))
    return gaps.unionByName(nested).unionByName(counts).unionByName(leaves)
