"""Listings of a snapshot, and what changed between two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.numbering import number_rows


def _listing(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows numbered by the given columns; equal rows are told apart by all they hold."""
    row = F.xxhash64(*rows.columns).alias("_row")
    return number_rows(rows.select(*columns, row), [*columns, "_row"]).select("number", *columns)


def list_types(node_data: DataFrame, tag: int | None = None, kind: str = "TypeSpec") -> DataFrame:
    """Numbered type names of a snapshot, by name: (number, name)."""
    rows = node_data.where(F.col("kind") == kind)
    rows = rows if tag is None else rows.where(F.col("tag") == tag)
    return _listing(rows.withColumnRenamed("data", "name"), "name")


def list_functions(func_decls: DataFrame, tag: int | None = None) -> DataFrame:
    """Numbered functions without a receiver, by name: (number, name)."""
    rows = func_decls if tag is None else func_decls.where(F.col("tag") == tag)
    return _listing(rows.where(F.col("receiver").isNull()), "name")


def list_methods(func_decls: DataFrame, tag: int | None = None) -> DataFrame:
    """Numbered methods, by receiver and name: (number, receiver, name)."""
    rows = func_decls if tag is None else func_decls.where(F.col("tag") == tag)
    return _listing(rows.where(F.col("receiver").isNotNull()), "receiver", "name")


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], keep_common: bool = False) -> DataFrame:
    """Keys with their status: added, removed, changed (and common, if wanted).

    Both sides hold one row per key; all other columns are compared, nulls being equal.
    """
    keys = list(keys)

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.select(*keys, F.struct(F.lit(1).alias("_there"), *rest).alias(name))

    both = side(before, "_b").join(side(after, "_a"), keys, "full")
    status = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "common")
        .otherwise("changed")
    )
    out = both.select(*keys, status.alias("status"))
    return out if keep_common else out.where(F.col("status") != "common")


def diff_commits(store, name: str, before: str, after: str, keys: Sequence[str], keep_common: bool = False) -> DataFrame:
    """Difference of a tagged table between two commits of a store, looked up by their names.

    Of a table laid out in ranges only the ranges that differ are read, unless common keys are wanted.
    """
    if not keep_common:
        return diff(*store.changed(name, before, after), keys)
    rows = store.read(name)
    first, second = (rows.where(F.col("tag") == store.tag_of(c)).drop("tag") for c in (before, after))
    return diff(first, second, keys, keep_common)


def functions_like(functions: DataFrame, links: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """Functions whose name matches, with number and kind of each body entry: (name, type, num, kind).

    The tag is part of both joins, so rows of other snapshots do not mix in.
    """
    wanted = functions.where(F.col("name").ilike(pattern)).select("tag", "name", "type", F.col("block_id").alias("id"))
    entries = links.select("tag", "id", F.col("link_number").alias("num"), "link_id")
    kinds = nodes.select("tag", F.col("id").alias("link_id"), "kind")
    return wanted.join(entries, ["tag", "id"]).join(kinds, ["tag", "link_id"]).select("name", "type", "num", "kind")
