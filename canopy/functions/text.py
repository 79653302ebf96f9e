"""String functions, locations (``file:line:col``) and source spans."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def repeat(s: Column, n: Column | int) -> Column:
    return F.repeat(s, F.lit(n) if isinstance(n, int) else n)


def basetype(c: Column) -> Column:
    """Type text without one leading ``*``."""
    return F.regexp_replace(c, r"^\*", "")


def stringify(c: Column) -> Column:
    return c.cast("string")


def qualified(package: Column, name: Column) -> Column:
    return F.concat(package, F.lit("."), name)


def split(c: Column, chars: str) -> Column:
    """Parts between any of the given characters; empty parts are dropped."""
    parts = F.split(c, "[" + "".join("\\" + ch if not ch.isalnum() else ch for ch in chars) + "]")
    return F.filter(parts, lambda p: p != "")


def trim(c: Column) -> Column:
    """Without white space at both ends, line ends and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trimsplit(c: Column, chars: str) -> Column:
    return F.transform(split(c, chars), trim)


def join(sep: str, parts: Column) -> Column:
    return F.array_join(parts, sep)


def interpolate(template: str, values: Mapping[str, Column]) -> Column:
    """``${name}`` marks replaced by columns; unknown marks stay as they are."""
    pieces, at = [], 0
    for mark in re.finditer(r"\$\{([^{}]*)\}", template):
        pieces.append(F.lit(template[at : mark.start()]))
        value = values.get(mark.group(1))
        pieces.append(F.lit(mark.group(0)) if value is None else value.cast("string"))
        at = mark.end()
    return F.concat(*pieces, F.lit(template[at:]))


def ilike(c: Column, pattern: str) -> Column:
    """LIKE that ignores letter case."""
    return c.ilike(pattern)


def format_line(fmt: str, *values: Column) -> Column:
    """One report line; a missing value is printed as ``<nil>``."""
    return F.format_string(fmt, *[F.coalesce(v.cast("string"), F.lit("<nil>")) for v in values])


# Locations ---------------------------------------------------------------------------------


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def column_at(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based character offset."""
    return F.char_length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def location(file: Column, line: Column, col: Column) -> Column:
    """``file:line:col``."""
    return F.concat_ws(":", file, line.cast("string"), col.cast("string"))


def offset_location(file: Column, text: Column, offset: Column) -> Column:
    return location(file, line_at(text, offset), column_at(text, offset))


# Line and column stand at the right end; the file may hold colons itself (``s3a://...``).
_LOCATION = r"(?s)^(.*):(\d+):(\d+)$"


def parse_location(c: Column) -> Column:
    """A struct (file, line, col); all null for text that is no location."""

    def part(n: int) -> Column:
        return F.nullif(F.regexp_extract(c, _LOCATION, n), F.lit(""))

    return F.struct(
        part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("col")
    )


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two parsed locations of a file: ``start`` included, ``end`` not.

    The lines in between are kept whole; each line of the slice is joined by a line end.
    """
    return _span_of(F.split(text, "\n"), start, end)


def _span_of(lines: Column, start: Column, end: Column) -> Column:
    lines = F.slice(lines, start["line"], end["line"] - start["line"] + 1)
    last = end["line"] - start["line"]

    def cut(line: Column, i: Column) -> Column:
        to = F.when(i == last, end["col"]).otherwise(F.char_length(line) + 1)
        begin = F.when(i == 0, start["col"]).otherwise(1)
        return F.substring(line, begin, F.greatest(to - begin, F.lit(0)))

    return F.array_join(F.transform(lines, cut), "\n")


def node_slices(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes (location, end_location, ...) with the ``slice`` of source text (path, content) they span.

    Locations are gathered by file, so a file's text is not repeated for each of its nodes; the
    list of one file's spans is no longer than the file.
    """
    start, end = parse_location(F.col("location")), parse_location(F.col("end_location"))
    spans = nodes.withColumn("_start", start).withColumn("_end", end).withColumn("path", F.col("_start.file"))
    rest = [c for c in nodes.columns if c != "path"]
    per_file = spans.groupBy("path").agg(F.collect_list(F.struct("_start", "_end", *rest)).alias("_spans"))
    # Lines once per file; a span then takes its own.
    split = sources.select("path", F.split("content", "\n").alias("_lines")).join(per_file, "path")
    cut = F.transform("_spans", lambda s: F.struct(s.alias("s"), _span_of(F.col("_lines"), s["_start"], s["_end"]).alias("slice")))
    one = split.select(F.explode(cut).alias("_x"))
    return one.select(*[F.col(f"_x.s.{c}").alias(c) for c in rest], F.col("_x.slice").alias("slice"))
