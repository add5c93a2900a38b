"""Path algebra as Column expressions: all of it stays in generated code on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Components of an absolute path with empty ones, ``.`` and ``..`` resolved; null if it isn't absolute or holds a NUL."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(path.startswith("/") & ~F.contains(path, F.lit("\0")), kept)


def normalize(path: Column) -> Column:
    """``//a/./b/../c///`` becomes ``/a/c``; canonical paths take a short way."""
    odd = path.rlike(r"//|/\.{1,2}(/|$)|/$") | ~path.startswith("/") | F.contains(path, F.lit("\0"))
    return F.when(path == "/", path).when(~odd, path).otherwise(F.concat(F.lit("/"), F.array_join(components(path), "/")))


def parent(path: Column) -> Column:
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def basename(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.substring_index(path, "/", -1))


def is_within(path: Column, root: Column) -> Column:
    """Component boundaries count: ``/ab`` isn't within ``/a``. Both paths are normalized."""
    return (path == root) | (root == "/") | path.startswith(F.concat(root, F.lit("/")))


def depth(path: Column) -> Column:
    return F.when(path == "/", F.lit(0)).otherwise(F.size(F.split(path, "/")) - 1)


def ancestors(path: Column, proper: bool = True) -> Column:
    """All ancestors of a normalized path, ``/`` first; with ``proper=False`` the path itself last.

    Exploded, they turn prefix joins into equi-joins.
    """
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts) - (1 if proper else 0)
    below = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    root = F.array(F.lit("/"))
    return F.when(path == "/", F.array().cast("array<string>") if proper else root).otherwise(F.concat(root, below))


def preorder_key(path: Column, folded_path: Column) -> Column:
    """An array that sorts entries parent first, siblings by folded then original name.

    Plain path order isn't preorder: ``a`` < ``a-`` < ``a/b``.
    """
    split = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    return F.zip_with(split(folded_path), split(path), lambda f, n: F.concat(f, F.lit("\x01"), n))
