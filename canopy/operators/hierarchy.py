"""Node and link rows of a hierarchy kept in flat tables (parent keys instead of nesting).

A nested record holding all descendants of a root would not fit a row once a root has
millions of them. The levels are therefore shredded from their own tables: node rows are plain
projections, and the positions of the children within their parent come from the balanced
numbering.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.numbering import number_rows


@dataclass(frozen=True)
class Level:
    """One table of the hierarchy: its kind, node id and data, and the link from its parent."""

    kind: str
    rows: DataFrame
    id: Column
    data: Column
    parent: Column | None = None
    label: str | None = None
    order: Column | None = None


def nodes(levels: Sequence[Level]) -> DataFrame:
    parts = [lv.rows.select(lv.id.alias("id"), F.lit(lv.kind).alias("kind"), lv.data.alias("data")) for lv in levels]
    return reduce(DataFrame.unionByName, parts)


def edges(levels: Sequence[Level]) -> DataFrame:
    """Links without their numbers: enough for walks and censuses, and no sort."""
    parts = [
        lv.rows.select(
            lv.parent.alias("id"), F.lit(lv.label).alias("label"), lv.order.alias("position"), lv.id.alias("link_id")
        )
        for lv in levels
        if lv.parent is not None
    ]
    return reduce(DataFrame.unionByName, parts)


def links(levels: Sequence[Level]) -> DataFrame:
    """Link rows; ``link_number`` counts the children of a parent from 1 by ``order``."""
    numbered = number_rows(edges(levels), ["position"], partition=["id", "label"], name="link_number")
    return numbered.select("id", "label", "link_number", "link_id")
