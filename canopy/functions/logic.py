"""Truth logic over columns of any type.

Null, false and the empty string are false; everything else is true, zero included.
``and_`` and ``or_`` return one of their operands, not a boolean. A Column does not tell its
type to Python, but ``typeof`` does so to Spark, which folds it: the type decides. Where the
caller knows it, ``of="string"`` or ``"boolean"`` gives a shorter expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column, of: str = "any") -> Column:
    if of == "string":
        return c.isNotNull() & (F.coalesce(c, F.lit("")) != "")
    if of == "boolean":
        return F.coalesce(c, F.lit(False))
    kind, text = F.typeof(c), c.cast("string")
    false = F.when(kind == "string", text == "").when(kind == "boolean", text == "false").otherwise(F.lit(False))
    return c.isNotNull() & ~F.coalesce(false, F.lit(True))


def not_(c: Column, of: str = "any") -> Column:
    return ~truthy(c, of)


def and_(a: Column, b: Column, of: str = "any") -> Column:
    """The second operand when the first is true, else the first."""
    return F.when(truthy(a, of), b).otherwise(a)


def or_(a: Column, b: Column, of: str = "any") -> Column:
    """The first operand when it is true, else the second."""
    return F.when(truthy(a, of), a).otherwise(b)


def xor(a: Column, b: Column, of: str = "any") -> Column:
    return truthy(a, of) != truthy(b, of)


def equal(a: Column, b: Column) -> Column:
    """Equality that holds for two nulls and is never null."""
    return a.eqNullSafe(b)


def nil(of: str = "string") -> Column:
    return F.lit(None).cast(of)


def member(c: Column, path: str) -> Column:
    """Nested member ``a.b.c`` of a struct column; null as soon as one step is null."""
    for name in path.split("."):
        c = c.getField(name)
    return c


def type_check(kind: Column, name: str) -> Column:
    return equal(kind, F.lit(name))
