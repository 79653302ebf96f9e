"""Declared tables: named, typed fields, key columns, and inserts that keep the first row of a key."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type names and the Spark types they are stored as (fixed values).
TYPES = {
    "TEXT": T.StringType(),
    "INTEGER": T.LongType(),
    "REAL": T.DoubleType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BLOB": T.BinaryType(),
    "TIMESTAMP": T.TimestampType(),
    "DATETIME": T.TimestampType(),
    "DATE": T.DateType(),
}

# Text forms of a point in time, tried in this order (fixed values); a fraction may have 1-9 digits.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
)


def to_timestamp(c: Column) -> Column:
    """A point in time from text in one of ``TIME_FORMATS`` or from unix seconds; else null."""
    text = c.cast("string")
    seconds = F.timestamp_seconds(F.when(text.rlike(r"^-?\d+$"), text).try_cast("bigint"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS], seconds)


@dataclass(frozen=True)
class Key:
    """Marks a field declaration as part of the primary key."""

    text: str


@dataclass(frozen=True)
class TableDef:
    name: str
    fields: tuple[tuple[str, T.DataType], ...]
    keys: tuple[str, ...]

    @classmethod
    def of(cls, name: str, *fields: str | Key) -> TableDef:
        """``TableDef.of("methods", Key("name"), Key("line:INTEGER"), "location")``."""
        _check_name(name)
        parsed, keys = [], []
        for field in fields:
            text = field.text if isinstance(field, Key) else field
            column, _, kind = text.partition(":")
            _check_name(column)
            kind = (kind or "TEXT").strip().upper()
            if kind not in TYPES:
                raise ValueError(f"unknown type {kind} for field {column}")
            parsed.append((column, TYPES[kind]))
            if isinstance(field, Key):
                keys.append(column)
        if len({c for c, _ in parsed}) != len(parsed):
            raise ValueError(f"table {name} names a field twice")
        return cls(name, tuple(parsed), tuple(keys))

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, t) for c, t in self.fields])

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def row(self, *values: Column) -> list[Column]:
        """The values as columns of this table: counted, cast and named."""
        if len(values) != len(self.fields):
            raise ValueError(f"{self.name} takes {len(self.fields)} values, got {len(values)}")
        return [_cast(v, t).alias(c) for v, (c, t) in zip(values, self.fields)]

    def store(self, df: DataFrame, *values: Column) -> DataFrame:
        """One row of this table per row of ``df``."""
        return df.select(*self.row(*values))

    def conform(self, df: DataFrame) -> DataFrame:
        return self.store(df, *[F.col(c) for c in self.columns])

    def literal(self, spark: SparkSession, rows: Sequence[Sequence]) -> DataFrame:
        """A table of constants."""
        width = len(self.fields)
        if any(len(r) != width for r in rows):
            raise ValueError(f"{self.name} takes {width} values per row")
        text = T.StructType([T.StructField(c, T.StringType()) for c in self.columns])
        values = [[v.decode() if isinstance(v, bytes) else None if v is None else str(v) for v in r] for r in rows]
        return self.conform(spark.createDataFrame(values, text))


def _check_name(name: str) -> None:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a table or field name: {name!r}")


def _cast(value: Column, to: T.DataType) -> Column:
    if isinstance(to, T.TimestampType):
        return to_timestamp(value)
    if isinstance(to, (T.StringType, T.BinaryType)):
        return value.cast(to)
    return value.try_cast(to)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the least by ``order`` (default: all other columns).

    Rows with a null in a key column never collide and all stay. The choice is an aggregate
    with map-side combine, so each task sends one row per key, however hot the key.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    order = list(order) if order else []
    ranked = [*order, *[c for c in others if c not in order]]
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    if not ranked:
        kept = df.where(complete).distinct()
    else:
        least = df.where(complete).groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_row"))
        kept = least.select(*[F.col("_row").getField(c).alias(c) if c in others else F.col(c) for c in df.columns])
    partial = df.where(~complete)
    return kept.unionByName(partial)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``new`` an insert would add to ``stored``: the first row of each key not there yet."""
    return first_per_key(new, keys, order).join(stored.select(*keys), list(keys), "left_anti").select(*new.columns)
