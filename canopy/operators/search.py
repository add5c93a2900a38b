"""Ranked name search with seven sort orders, bounded top-K and has-more."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.text import PAGE, fold_text, match_rank

SORTS = ("relevance", "name", "size", "mtime")


@dataclass(frozen=True)
class Request:
    query: str
    limit: int = PAGE
    sort: str = "relevance"
    descending: bool | None = None

    def __post_init__(self):
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")

    @property
    def desc(self) -> bool:
        """Sizes and times start with the largest, the others don't."""
        return self.sort in ("size", "mtime") if self.descending is None else self.descending


def resolve_sort(sort: str, metadata_available: bool) -> str:
    """Sizes and times can't sort while metadata is missing."""
    return sort if metadata_available or sort in ("relevance", "name") else "relevance"


def sort_keys(r: Request, display: bool = False) -> list[Column]:
    """A total order: ties end in path, then (where volumes have one) in the display name, then in the volume."""
    end = [F.col("display").asc()] * display + [F.col("volume").asc()]
    rest = [F.col("match_rank").asc(), F.col("folded").asc(), F.col("path").asc(), *end]
    if r.sort == "relevance":
        return rest
    if r.sort == "name":
        ways = [F.col(c).desc() if r.desc else F.col(c).asc() for c in ("folded", "name")]
        return [*ways, F.col("path").asc(), *end]
    return [F.col(r.sort).desc_nulls_last() if r.desc else F.col(r.sort).asc_nulls_last(), *rest]


def gated(rows: DataFrame) -> DataFrame:
    """Only files have a size: it must be gone before rows are ordered by it."""
    return rows.withColumn("size", F.when(F.col("kind") == "file", F.col("size"))) if "size" in rows.columns else rows


def matches(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose folded name holds the folded query, with their match rank; the predicate reaches a Parquet scan."""
    q = fold_text(query)
    if not q:
        return rows.limit(0).withColumn("match_rank", F.lit(0))
    return rows.where(F.contains("folded", F.lit(q))).withColumn("match_rank", match_rank(F.col("folded"), q))


def search(rows: DataFrame, r: Request, metadata: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` hits with ``pos`` from 1; an empty query or limit gives none.

    ``metadata(volume, path, size, mtime)`` is joined after the limit where
    the order doesn't need it, before it where it does; its sizes and times
    stand for those of the rows.
    """
    found = matches(rows, r.query if r.limit > 0 else "")
    if metadata is not None:
        found = found.drop("size", "mtime")
    late = metadata is not None and r.sort in ("relevance", "name")
    if metadata is not None and not late:
        found = found.join(metadata.select("volume", "path", "size", "mtime"), ["volume", "path"], "left")
    keys = sort_keys(r, "display" in rows.columns)
    top = gated(found).orderBy(*keys).limit(max(0, r.limit))
    if late:
        top = gated(top.join(metadata.select("volume", "path", "size", "mtime"), ["volume", "path"], "left"))
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*keys)))  # of limit rows


def search_page(rows: DataFrame, r: Request, metadata: DataFrame | None = None) -> tuple[list, bool]:
    """Hits of one page, and whether there are more: one row more than the page is fetched."""
    more = Request(r.query, r.limit + 1 if r.limit > 0 else 0, r.sort, r.descending)
    hits = search(rows, more, metadata).orderBy("pos").collect()
    return hits[: max(0, r.limit)], len(hits) > max(0, r.limit)


def per_volume_top(rows: DataFrame, r: Request) -> DataFrame:
    """The first hits of every volume; rank filters run before and after the shuffle."""
    w = Window.partitionBy("volume").orderBy(*sort_keys(r))
    return gated(matches(rows, r.query)).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= r.limit)


def first_by_place(rows: DataFrame, r: Request) -> DataFrame:
    """One row per (volume, path): the first in sort order. Equal paths on two volumes both stay."""
    w = Window.partitionBy("volume", "path").orderBy(*sort_keys(r))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cancellable(rows: DataFrame, tag: str) -> list:
    """Collect under a tag, after a job of the same tag is cancelled: the latest request wins."""
    sc = rows.sparkSession.sparkContext
    sc.cancelJobsWithTag(tag)
    sc.addJobTag(tag)
    try:
        return rows.collect()
    finally:
        sc.removeJobTag(tag)
