"""Combinators for functions from Column to Column: rules are built from small pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

ColumnFunction = Callable[..., Column]


def compose(f: ColumnFunction, g: ColumnFunction) -> ColumnFunction:
    """f of g."""
    return lambda *args: f(g(*args))


def curry(f: ColumnFunction, value, index: int = 1) -> ColumnFunction:
    """f with its argument at the 1-based position fixed."""
    return lambda *args: f(*args[: index - 1], value, *args[index - 1 :])


def inject(f: ColumnFunction, g: ColumnFunction, index: int = 1) -> ColumnFunction:
    """f with g applied to its argument at the 1-based position first."""
    return lambda *args: f(*args[: index - 1], g(args[index - 1]), *args[index:])


def inject_all(f: ColumnFunction, g: ColumnFunction) -> ColumnFunction:
    """f with g applied to every argument first."""
    return lambda *args: f(*map(g, args))
