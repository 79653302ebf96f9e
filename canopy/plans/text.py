"""Files, source text, locations and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import text
from canopy.plans.bindings import table
from canopy.plans.registry import query
from canopy.session import spread
from canopy.sources import declarations as decl
from canopy.sources import files


@query(
    """SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem',
  'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS stem, true AS has_content, CAST(1 AS BIGINT) AS folders"""
)
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files below the data folder, and the number of folders holding them."""
    found = files.find_files(spark, sf_dir, "*.parquet", F.col("length") > 0)
    folders = files.find_packages(found).agg(F.count(F.lit(1)).alias("folders"))
    stem = F.regexp_extract("path", r"([^/]*)\.parquet$", 1)
    return found.select(
        stem.alias("stem"), (F.col("length") > 0).alias("has_content"), folders.scalar().alias("folders")
    )


@query(
    """WITH d AS (SELECT doc_id, text, length(text) // 2 AS half FROM documents),
 h AS (SELECT doc_id, string_split(substr(text, 1, half), chr(10)) AS head FROM d)
SELECT doc_id, 'doc' || doc_id || ':' || len(head) || ':' || (length(head[-1]) + 1) AS location,
  'doc' || doc_id AS file, CAST(len(head) AS INTEGER) AS line, CAST(length(head[-1]) + 1 AS INTEGER) AS col FROM h"""
)
def span_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of the middle of each text, and its parts read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("char_length(text) div 2").cast("int").alias("half"))
    file = F.concat(F.lit("doc"), "doc_id")
    located = docs.select("doc_id", text.offset_location(file, F.col("text"), F.col("half")).alias("location"))
    return located.select("doc_id", "location", text.parse_location(F.col("location")).alias("p")).select(
        "doc_id", "location", "p.*"
    )


@query(
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 1 THEN '' WHEN len(l) = 2 THEN substr(l[2], 3)
  ELSE substr(l[2], 3) || chr(10) || substr(l[3], 1, 4) END AS slice FROM d"""
)
def span_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text from column 3 of line 2 up to column 5 of line 3."""
    start, end = (text.parse_location(F.lit(p)) for p in ("doc:2:3", "doc:3:5"))
    return table(spark, sf_dir, "documents").select("doc_id", text.span_slice(F.col("text"), start, end).alias("slice"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
 n AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS body FROM l)
SELECT 's3a://docs/' || doc_id || ':' || line || ':1' AS location, substr(body, 1, greatest(length(body) - 1, 0)) AS slice FROM n"""
)
def node_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the locations of lines, joined to the source text on the file of the location."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sources = docs.select(F.concat(F.lit("s3a://docs/"), "doc_id").alias("path"), F.col("text").alias("content"))
    line = F.posexplode(F.split("content", "\n")).alias("_i", "_line")
    nodes = sources.select("path", line).select(
        text.location(F.col("path"), F.col("_i") + 1, F.lit(1)).alias("location"),
        text.location(F.col("path"), F.col("_i") + 1, F.greatest(F.char_length("_line"), F.lit(1))).alias("end_location"),
    )
    return text.node_slices(nodes, sources).select("location", "slice")


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part, declaring a struct, its methods, a contract and a function."""
    part = spread(table(spark, sf_dir, "part"), min_bytes=0)
    name = F.concat(F.initcap(F.replace("p_name", F.lit(" "), F.lit(""))), "p_partkey")
    pkg = F.lower("p_type")
    lines = [
        F.concat(F.lit("package "), pkg),
        F.lit(""),
        F.concat(F.lit("type "), name, F.lit(" struct {")),
        F.lit("\tsize, weight int // measures"),
        F.lit("\tBase"),
        F.concat(F.lit("\t*stock."), F.replace("p_brand", F.lit("#"), F.lit(""))),
        F.lit("}"),
        F.lit(""),
        F.concat(F.lit("type "), name, F.lit("Seller interface { Price(currency string, net bool) (float64, error); Sized }")),
        F.concat(F.lit("type "), name, F.lit("Sizes []int")),
        F.lit(""),
        F.concat(F.lit("func (p *"), name, F.lit(") Price(currency string, net bool) (float64, error) {")),
        F.lit("\treturn 0, nil"),
        F.lit("}"),
        F.lit(""),
        F.concat(F.lit("func New"), name, F.lit("(a, b int, from *"), name, F.lit(", tags ...string) *"), name, F.lit(" { return nil }")),
    ]
    path = F.concat(F.lit("src/"), pkg, F.lit("/"), F.col("p_partkey"), F.lit(".go"))
    return part.select(path.alias("path"), F.concat_ws("\n", *lines).alias("content"))


@query(
    """WITH p AS (SELECT lower(p_type) AS pkg, replace(p_brand, '#', '') AS brand,
  'src/' || lower(p_type) || '/' || p_partkey || '.go' AS path,
  upper(substr(replace(p_name, ' ', ''), 1, 1)) || lower(substr(replace(p_name, ' ', ''), 2)) || p_partkey AS n FROM part)
SELECT 'structs' AS "table", pkg || '.' || n AS k1, NULL AS k2, NULL AS k3, path || ':3:6' AS location FROM p
UNION ALL SELECT 'types', pkg || '.' || n, NULL, NULL, path || ':3:6' FROM p
UNION ALL SELECT 'types', pkg || '.' || n || 'Seller', NULL, NULL, path || ':9:6' FROM p
UNION ALL SELECT 'types', pkg || '.' || n || 'Sizes', NULL, NULL, path || ':10:6' FROM p
UNION ALL SELECT 'interfaces', pkg || '.' || n || 'Seller', NULL, NULL, path || ':9:6' FROM p
UNION ALL SELECT 'struct_inherits', pkg || '.' || n, pkg || '.Base', NULL, NULL FROM p
UNION ALL SELECT 'struct_inherits', pkg || '.' || n, 'stock.' || brand, NULL, NULL FROM p
UNION ALL SELECT 'interface_inherits', pkg || '.' || n || 'Seller', pkg || '.Sized', NULL, NULL FROM p
UNION ALL SELECT 'interface_reqs', pkg || '.' || n || 'Seller', 'Price', 'func(string, bool) (float64, error)',
  path || ':9:' || (length(n) + 25) FROM p
UNION ALL SELECT 'methods', 'Price', 'func(string, bool) (float64, error)', pkg || '.' || n, path || ':12:1' FROM p
UNION ALL SELECT 'functions', 'New' || n, 'func(int, int, *' || pkg || '.' || n || ', ...string) *' || pkg || '.' || n, NULL, path || ':16:1' FROM p"""
)
def extract_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text derived from the parts, taken apart again by the declaration rules."""
    sources = part_sources(spark, sf_dir)
    rules = decl.declaration_rules()
    keys = {t.name: [c for c in t.columns if c != "location"] for t in rules.targets()}
    placed = [t.name for t in rules.targets() if "location" in t.columns]

    def cell(i: int):
        return F.coalesce(*[F.col(f"{name}.{columns[i]}") for name, columns in keys.items() if i < len(columns)])

    return rules.emit(decl.declarations(sources)).select(
        "table",
        *[cell(i).alias(f"k{i + 1}") for i in range(3)],
        F.coalesce(*[F.col(f"{name}.location") for name in placed]).alias("location"),
    )
