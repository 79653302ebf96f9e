"""List and map functions. Positions given to ``index`` are 0-based, all others 1-based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(c: Column, of: str = "list") -> Column:
    """Number of elements or characters; null for null."""
    return F.char_length(c) if of == "string" else F.size(c)


def is_empty(c: Column) -> Column:
    """True for an empty list and for no list at all."""
    return F.coalesce(F.size(c), F.lit(0)) == 0


def index(c: Column, i: Column | int) -> Column:
    """Element i counted from 0; null past the end."""
    return F.get(c, F.lit(i) if isinstance(i, int) else i)


def map_list(f: Callable[[Column], Column], c: Column) -> Column:
    """f of every element, null results left out."""
    return F.array_compact(F.transform(c, lambda x: f(x)))


def append_all(*lists: Column) -> Column:
    """All lists end to end; a missing list counts as empty."""
    return F.flatten(F.array_compact(F.array(*lists)))


def contains(c: Column, value) -> Column:
    return F.coalesce(F.array_contains(c, value), F.lit(False))


def index_of(c: Column, value) -> Column:
    """1-based position of the first equal element; null when there is none."""
    at = F.array_position(c, value)
    return F.when(at > 0, at)


def keys(m: Column) -> Column:
    return F.map_keys(m)


def merge(m: Column, into: Column) -> Column:
    """Both maps together; an entry of ``m`` replaces the entry of ``into`` with the same key."""
    kept = F.map_filter(into, lambda k, v: ~F.array_contains(F.map_keys(m), k))
    return F.map_concat(kept, m)
