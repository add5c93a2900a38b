"""Name folding, match ranks, checked time arithmetic and display."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 50


def fold_text(s: str) -> str:
    """Full case folding, then NFC: ``STRASSE`` meets ``Straße``, composed meets decomposed, accents stay."""
    return s.lower() if s.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).casefold())


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.char_length(s)


def fold_ascii(s: Column) -> Column:
    """Folding of names known to be ASCII, in generated code."""
    return F.lower(s)


def with_folded(df: DataFrame, name: str = "name", out: str = "folded") -> DataFrame:
    """``df`` with the folded name, materialized once at load so that queries push a plain predicate down.

    ASCII rows stay on the JVM; the rest pass an Arrow-batched function.
    """
    ascii_rows = df.where(F.col(name).isNull() | is_ascii(F.col(name))).withColumn(out, F.lower(name))
    others = df.where(~is_ascii(F.col(name))).withColumn(out, F.pandas_udf(_folded, "string")(F.col(name)))
    return ascii_rows.unionByName(others)


def match_rank(folded: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring; ``query`` is folded."""
    return F.when(folded == query, 0).when(folded.startswith(query), 1).otherwise(2)


def unix_nanos(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds since the epoch; null if the part is out of range or the result overflows."""
    return F.when(nanos.between(0, 999_999_999), F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000).cast("long")), nanos))


def size_text(size: Column) -> Column:
    """Size for display: a dash for none, decimal units."""
    s = size.cast("double")
    return (
        F.when(size.isNull(), F.lit("—"))
        .when(size < 1000, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1_000_000, F.concat(F.format_number(s / 1e3, 1), F.lit(" kB")))
        .when(size < 1_000_000_000, F.concat(F.format_number(s / 1e6, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(s / 1e9, 1), F.lit(" GB")))
    )


def time_text(ns: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("long")), "yyyy-MM-dd HH:mm:ss"), F.lit("—"))


def required_space(total: Column) -> Column:
    """Bytes a copy needs: the total plus the larger of 256 MiB and a tenth, rounded up; null on overflow."""
    rest = F.pmod(total, F.lit(10))
    tenth = F.call_function("div", total - rest, F.lit(10).cast("long"))
    return F.try_add(total, F.greatest(F.lit(256 * 2**20).cast("long"), tenth + (rest > 0).cast("long")))


def backoff_seconds(failures: Column, most: int = 30) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2), F.greatest(F.lit(0), F.least(failures, F.lit(8)))).cast("int"))
