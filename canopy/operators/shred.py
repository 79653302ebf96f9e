"""Nested records to node and link tables.

The reference visits a tree node by node. Here a declaration of the record's shape becomes one
array expression over the record: every node below it, with its path. One ``explode`` gives
all node rows and link rows in a single scan without a shuffle; an array is never larger than
the record it comes from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.tables import Key, TableDef

NODE_DATA = TableDef.of(
    "node_data", Key("tag:INTEGER"), Key("id:INTEGER"), "kind", "data", "location", "end_location", "type"
)
NODE_LINKS = TableDef.of(
    "node_links", Key("tag:INTEGER"), Key("id:INTEGER"), Key("label"), Key("link_number:INTEGER"), "link_id:INTEGER"
)

#: Ids that a task compares when it looks for equal ones.
TASK_IDS = 2_000_000


@dataclass(frozen=True)
class Node:
    """Shape of one kind: the field with its data, single children, lists of children.

    ``data``, ``location``, ``end_location`` and ``type`` name fields of the record, or are
    functions from the record column to a column; ``data="."`` takes the record itself (a
    list of plain values). ``links`` and ``lists`` map a label, which is also the field name,
    to the shape of the child.
    """

    kind: str
    data: object = None
    links: Mapping[str, Node] = field(default_factory=dict)
    lists: Mapping[str, Node] = field(default_factory=dict)
    location: object = None
    end_location: object = None
    type: object = None

    @classmethod
    def infer(cls, schema: T.StructType, kind: str, data: str | None = None) -> Node:
        """The shape given by a schema: structs are single children, arrays lists of children.

        ``data`` names the scalar field to keep, where a record has it. A child's kind is its
        label.
        """
        links, lists = {}, {}
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                links[f.name] = cls.infer(f.dataType, f.name, data)
            elif isinstance(f.dataType, T.ArrayType):
                element = f.dataType.elementType
                lists[f.name] = cls.infer(element, f.name, data) if isinstance(element, T.StructType) else cls(f.name, ".")
        scalar = data if data in schema.names and data not in links and data not in lists else None
        return cls(kind, scalar, links, lists)


ATTRIBUTES = ("data", "location", "end_location", "type")


def _entry(attributes: Sequence[str]) -> str:
    fields = ["path:string", "parent:string", "label:string", "link_number:bigint", "kind:string", *(f"{a}:string" for a in attributes)]
    return f"struct<{','.join(fields)}>"


def _attribute(record: Column, what) -> Column:
    if what is None:
        return F.lit(None).cast("string")
    if callable(what):
        return what(record).cast("string")
    return (record if what == "." else record.getField(what)).cast("string")


def _entries(
    node: Node, record: Column, path: Column, parent: Column, label: Column, number: Column, attributes: Sequence[str]
) -> Column:
    present, entry = record.isNotNull(), _entry(attributes)
    own = F.array(
        F.struct(
            F.when(present, path).alias("path"),
            parent.alias("parent"),
            label.alias("label"),
            number.cast("bigint").alias("link_number"),
            F.lit(node.kind).alias("kind"),
            *[_attribute(record, getattr(node, a)).alias(a) for a in attributes],
        ).cast(entry)
    )
    parts = [own]
    for name, child in node.links.items():
        inner = _entries(
            child, record.getField(name), F.concat(path, F.lit(f"/{name}")), path, F.lit(name), F.lit(None), attributes
        )
        parts.append(F.when(present, inner).otherwise(F.array().cast(f"array<{entry}>")))
    for name, child in node.lists.items():
        inner = F.flatten(F.transform(record.getField(name), _element(name, child, path, attributes)))
        parts.append(F.coalesce(inner, F.array().cast(f"array<{entry}>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _element(name: str, child: Node, path: Column, attributes: Sequence[str]):
    def entries(x: Column, i: Column) -> Column:
        place = F.concat(path, F.lit(f"/{name}["), (i + 1).cast("string"), F.lit("]"))
        return _entries(child, x, place, path, F.lit(name), i + 1, attributes)

    return entries


def shred(
    df: DataFrame, shape: Node, path: Column, keep: Sequence[str] = (), attributes: Sequence[str] = ATTRIBUTES
) -> DataFrame:
    """All nodes of all records: path, parent, label, link_number, kind, data and locations.

    ``path`` names the record's root and must be unique per record. A child that is null
    keeps its link, with a null path. ``keep`` names columns of the record that each row gets in
    front, ``attributes`` those of data and locations that are wanted.
    """
    record = F.struct(*[F.col(c) for c in df.columns])
    none = F.lit(None).cast("string")
    entries = _entries(shape, record, path.cast("string"), none, none, F.lit(None), attributes)
    return df.select(*keep, F.explode(entries).alias("_n")).select(*keep, "_n.*")


def path_id(path: Column) -> Column:
    """64-bit id of a path; the same on every run and for every tag."""
    return F.xxhash64(path)


def nodes(shredded: DataFrame, ids: bool = False) -> DataFrame:
    """Node rows; ``ids`` turns paths into 64-bit ids."""
    rows = shredded.where(F.col("path").isNotNull())
    key = path_id(F.col("path")) if ids else F.col("path")
    return rows.select(key.alias("id"), "kind", "data", "location", "end_location", "type")


def links(shredded: DataFrame, ids: bool = False) -> DataFrame:
    """Link rows: list children carry their 1-based number, single children none."""
    rows = shredded.where(F.col("parent").isNotNull())
    if ids:
        own = F.when(F.col("path").isNotNull(), path_id(F.col("path")))
        return rows.select(path_id(F.col("parent")).alias("id"), "label", "link_number", own.alias("link_id"))
    return rows.select(F.col("parent").alias("id"), "label", "link_number", F.col("path").alias("link_id"))


def joined(shredded: DataFrame, within: Sequence[str]) -> DataFrame:
    """The rows of ``nodes`` and ``links`` under 64-bit ids, joined by id in one pass: columns ``within``, id, kind,
    n_nodes, n_links, children (links that lead to a node) and different_children.

    Columns ``within`` are the same all over a tree, so a node meets its links there; where ``shredded`` is
    partitioned by them, nothing is shuffled.
    """
    own, up = (F.when(F.col(c).isNotNull(), path_id(F.col(c))) for c in ("path", "parent"))
    named = shredded.select(*within, own.alias("_own"), up.alias("_up"), "kind")
    node = F.struct(F.col("_own").alias("id"), F.col("kind").alias("kind"), F.lit(None).cast("bigint").alias("link_id"))
    link = F.struct(F.col("_up").alias("id"), F.lit(None).cast("string").alias("kind"), F.col("_own").alias("link_id"))
    rows = named.select(*within, F.explode(F.array(node, link)).alias("_r")).select(*within, "_r.*").where("id IS NOT NULL")
    apart = rows.groupBy(*within, "id", "link_id").agg(F.max("kind").alias("kind"), F.count("kind").alias("_nodes"), F.count(F.lit(1)).alias("_rows"))
    return apart.groupBy(*within, "id").agg(
        F.max("kind").alias("kind"),
        F.sum("_nodes").alias("n_nodes"),
        F.sum(F.col("_rows") - F.col("_nodes")).alias("n_links"),
        F.coalesce(F.sum(F.when(F.col("link_id").isNotNull(), F.col("_rows"))), F.lit(0)).alias("children"),
        F.count("link_id").alias("different_children"),
    ).where("n_nodes > 0")


def check_ids(node_rows: DataFrame, rows: int | None = None) -> None:
    """Fail when two nodes share an id (a hash collision, or a path used twice).

    With the number of ``rows`` known, they are dealt out by id so that a task counts ``TASK_IDS`` of them.
    """
    if rows is not None:
        cores = node_rows.sparkSession.sparkContext.defaultParallelism
        node_rows = node_rows.select("id").repartition(max(cores, -(-rows // TASK_IDS)), "id")
    twice = node_rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("node ids are not unique")
