"""Text to trees with a pluggable tree builder; the only per-row Python of the package.

Each task parses the texts of its own batches and hands the nodes back in batches of bounded
size. Nothing is shuffled. A text whose builder fails yields one row with ``error`` set.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parsing code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that never have an end tag (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# A node: number in the text, parent's number or None, 1-based place in the parent, kind,
# data, depth, line and column of its start.
TreeNode = tuple[int, int | None, int | None, str, str | None, int, int, int]
TreeBuilder = Callable[[str], Iterable[TreeNode]]

_COLUMNS = ["node", "parent", "link_number", "kind", "data", "depth", "line", "col"]
_SCHEMA = "node int, parent int, link_number int, kind string, data string, depth int, line int, col int, error string"


class _HtmlTree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[TreeNode] = []
        self.open: list[tuple[int, str]] = []
        self.counts: dict[int | None, int] = {}

    def add(self, kind: str, data: str | None) -> int:
        parent = self.open[-1][0] if self.open else None
        place = self.counts[parent] = self.counts.get(parent, 0) + 1
        line, col = self.getpos()
        number = len(self.nodes)
        self.nodes.append((number, parent, None if parent is None else place, kind, data, len(self.open), line, col + 1))
        return number

    def handle_starttag(self, tag, attrs):
        number = self.add(tag, None)
        if tag not in VOID:
            self.open.append((number, tag))

    def handle_startendtag(self, tag, attrs):
        self.add(tag, None)

    def handle_endtag(self, tag):
        if any(t == tag for _, t in self.open):
            while self.open.pop()[1] != tag:
                pass

    def handle_data(self, data):
        if data.strip():
            self.add("#text", data)


def html_tree(text: str) -> list[TreeNode]:
    """Elements and non-blank texts of a page, in document order."""
    parser = _HtmlTree()
    parser.feed(text)
    parser.close()
    return parser.nodes


def parse_trees(
    df: DataFrame, key: str, text: str, builder: TreeBuilder = html_tree, texts: bool = True, batch: int = 50_000
) -> DataFrame:
    """One row per node of every text: the key, the node columns and ``error``.

    ``texts=False`` leaves out text nodes inside the task, before rows travel to the JVM.
    """
    columns = [key, *_COLUMNS, "error"]

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for c in ("parent", "link_number", "node", "depth", "line", "col"):
            out[c] = out[c].astype("Int32")
        return out

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                try:
                    rows.extend((k, *n, None) for n in builder(t) if texts or n[3] != "#text")
                except Exception as problem:  # noqa: BLE001 - a bad text must not fail the load
                    rows.append((k, *[None] * len(_COLUMNS), f"{type(problem).__name__}: {problem}"))
                if len(rows) >= batch:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(parse, f"{key} {key_type}, {_SCHEMA}")


def parsed(trees: DataFrame) -> DataFrame:
    return trees.where(F.col("error").isNull()).drop("error")


def quarantine(trees: DataFrame, key: str) -> DataFrame:
    """The texts that could not be turned into a tree, with the reason."""
    return trees.where(F.col("error").isNotNull()).select(key, "error")


def node_path(key: str, node: str = "node"):
    return F.concat_ws("/", F.col(key).cast("string"), F.col(node).cast("string"))


def tree_nodes(trees: DataFrame, key: str) -> DataFrame:
    return parsed(trees).select(node_path(key).alias("id"), "kind", "data", "depth", "line", "col")


def tree_links(trees: DataFrame, key: str) -> DataFrame:
    """Link rows of all trees, with the depth of the child."""
    return (
        parsed(trees)
        .where(F.col("parent").isNotNull())
        .select(
            node_path(key, "parent").alias("id"),
            F.lit("children").alias("label"),
            "link_number",
            node_path(key).alias("link_id"),
            "depth",
        )
    )


def tag_names(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of every element that begins in a page, by one pattern and no tree."""
    tags = F.regexp_extract_all(F.col(text), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return pages.select(key, F.explode(F.transform(tags, F.lower)).alias("kind"))
