"""The tables of a source-code store, ready declared."""

from __future__ import annotations

from collections.abc import Sequence

from canopy.operators.shred import NODE_DATA, NODE_LINKS
from canopy.operators.tables import Key, TableDef
from canopy.sources.declarations import (
    FUNCTIONS,
    INTERFACE_INHERITS,
    INTERFACE_REQS,
    INTERFACES,
    METHODS,
    STRUCT_INHERITS,
    STRUCTS,
    TYPES,
)

FUNC_DECL = TableDef.of(
    "FuncDecl",
    Key("tag:INTEGER"),
    Key("id:INTEGER"),
    "location",
    "end_location",
    "name",
    "receiver",
    "type",
    "block_id:INTEGER",
)
TYPE_DECLARATIONS = TableDef.of("type_declarations", Key("name"), "location")
TYPE_METHOD_INHERITS = TableDef.of("type_method_inherits", Key("type"), Key("embedded_type"))
BLOCKS = TableDef.of(
    "blocks", Key("tag:INTEGER"), Key("id:INTEGER"), Key("entry_num:INTEGER"), "location", "entry_tag:INTEGER"
)

SNAPSHOT_TABLES = (NODE_DATA, NODE_LINKS, FUNC_DECL)
SATISFACTION_TABLES = (
    METHODS, FUNCTIONS, STRUCTS, INTERFACES, INTERFACE_REQS, INTERFACE_INHERITS, STRUCT_INHERITS, TYPES,
)


def kind_table(kind: str, data: Sequence[str] = (), children: Sequence[str] = ()) -> TableDef:
    """The wide table of a node kind: its data fields and one ``<child>_id`` per single child."""
    ids = [f"{c}_id:INTEGER" for c in children]
    return TableDef.of(kind, Key("tag:INTEGER"), Key("id:INTEGER"), "location", *data, *ids)
