"""Stores, tags, listings, differences and incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import snapshots
from canopy.operators.rules import Event, RuleSet
from canopy.operators.rules import Store as RuleStore
from canopy.operators.tables import Key, TableDef
from canopy.plans.bindings import SCHEMAS, table
from canopy.plans.registry import query
from canopy.session import scratch_path
from canopy.sources.analyze import analyze
from canopy.sources.ranges import Ranges
from canopy.sources.store import Store, allocate_tags
from canopy.streaming.load import file_stream, load_new_keys, load_snapshots, read_new_keys

MONEY = "decimal(18,2)"
CUSTOMERS = TableDef.of("customers", Key("id:INTEGER"), "name", "segment", "nation:INTEGER")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, open again, drop, fill again, insert the same keys once more."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    path = scratch_path(spark, "store")
    Store(spark, path, [CUSTOMERS], fresh=True).append("customers", rows.withColumn("segment", F.lit("dropped")))
    store = Store(spark, path, [CUSTOMERS], must_exist=True)
    store.drop_all()
    store.append("customers", rows)
    store.append("customers", rows.withColumn("segment", F.lit("ignored")))
    return store.read("customers")


SUPPLIERS = TableDef.of("suppliers", Key("id:INTEGER"), "name", "nation:INTEGER", "balance:REAL")


@query(
    """SELECT s_suppkey AS id, s_name || '!' AS name FROM supplier
WHERE s_nationkey IN (3, 7, 11) AND s_acctbal > 1000.5 OR s_name ILIKE '%9'"""
)
def sql_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").toDF("id", "name", "nation", "balance")
    store = Store(spark, scratch_path(spark, "store"), [SUPPLIERS], fresh=True)
    store.append("suppliers", rows)
    return store.query(
        'SELECT id, name || "!" AS name FROM suppliers WHERE nation IN (?, ?, ?) AND balance > ? OR name ILIKE ?',
        3, 7, 11, 1000.5, "%9",
    )


@query(
    """WITH months AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS commit_id FROM orders),
 old AS (SELECT row_number() OVER (ORDER BY commit_id) AS tag, commit_id FROM months WHERE commit_id LIKE '1996-%')
SELECT tag, commit_id FROM old UNION ALL
SELECT (SELECT coalesce(max(tag), 0) FROM old) + row_number() OVER (ORDER BY commit_id), commit_id
FROM months WHERE commit_id NOT LIKE '1996-%'"""
)
def tag_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order months as commits: first those of 1996, then all, of which the old ones keep their tags."""
    month = F.date_format("o_orderdate", "yyyy-MM").alias("commit_id")
    commits = table(spark, sf_dir, "orders").select(month).distinct()
    none = spark.createDataFrame([], "tag bigint, commit_id string")
    old = allocate_tags(none, commits.where(F.col("commit_id").like("1996-%")))
    return old.unionByName(allocate_tags(old, commits))


ORDERS = TableDef.of("orders_at", Key("tag:INTEGER"), Key("id:INTEGER"), "priority", "price:REAL")


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS commit_id,
  CASE WHEN strftime(o_orderdate, '%Y-%m') = '1995-06' THEN 'changed' ELSE o_orderpriority END AS priority,
  count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price
FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1997-01' GROUP BY 1, 2"""
)
def replace_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months loaded as snapshots, one loaded again with changes, one removed."""
    rows = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("commit_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )
    store = Store(spark, scratch_path(spark, "store"), [ORDERS], fresh=True)
    months = [r["commit_id"] for r in rows.select("commit_id").distinct().collect()]  # one row per month
    store.load_many(sorted(months), {"orders_at": rows})
    again = rows.where(F.col("commit_id") == "1995-06").drop("commit_id").withColumn("priority", F.lit("changed"))
    store.load("1995-06", {"orders_at": again})
    store.remove_commit("1997-01")
    return (
        store.read("orders_at")
        .join(store.tags(), "tag")
        .groupBy("commit_id", "priority")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast(MONEY)).cast("double").alias("price"))
    )


@query(
    """WITH t AS (SELECT year(o_orderdate) AS y, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS price, count(*) AS n
   FROM orders GROUP BY 1, 2),
 b AS (SELECT * FROM t WHERE y = 1995), a AS (SELECT * FROM t WHERE y = 1996)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
  CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed'
       WHEN a.price = b.price AND a.n = b.n THEN 'common' ELSE 'changed' END AS status
FROM b FULL JOIN a ON a.o_custkey = b.o_custkey"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in one year against the next; the payload is their total."""
    orders = table(spark, sf_dir, "orders")

    def year(first: str, after: str) -> DataFrame:
        within = (F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (
            F.col("o_orderdate") < F.lit(after).cast("timestamp_ntz")
        )
        return orders.where(within).groupBy("o_custkey").agg(
            F.sum(F.col("o_totalprice").cast(MONEY)).alias("price"), F.count(F.lit(1)).alias("n")
        )

    return snapshots.diff(year("1995-01-01", "1996-01-01"), year("1996-01-01", "1997-01-01"), ["o_custkey"], keep_common=True)


_YEAR_DIFF = """
WITH t AS (SELECT year(o_orderdate) AS y, o_custkey AS id, o_orderstatus AS status,
   count(*) AS n FROM orders GROUP BY 1, 2, 3),
 b AS (SELECT * FROM t WHERE y = 1995), a AS (SELECT * FROM t WHERE y = 1996)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.status, b.status) AS status_of,
  CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM b FULL JOIN a ON a.id = b.id AND a.status = b.status WHERE a.n IS DISTINCT FROM b.n"""

COUNTS = TableDef.of("counts_at", Key("tag:INTEGER"), Key("id:INTEGER"), Key("status_of"), "n:INTEGER")


@query(_YEAR_DIFF)
def commit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored commits, found by name and compared: orders analysed by rules into a tagged store."""
    orders = table(spark, sf_dir, "orders")
    store = Store(spark, scratch_path(spark, "store"), [COUNTS], fresh=True)
    rules = RuleSet(Event(None, RuleStore(COUNTS, F.lit(None), F.col("id"), F.col("status_of"), F.col("n"))))
    for commit in ("1995", "1996"):
        records = orders.where(F.year("o_orderdate") == int(commit)).groupBy(
            F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status_of")
        )
        analyze(records.agg(F.count(F.lit(1)).alias("n")), rules, store, commit)
    return snapshots.diff_commits(store, "counts_at", "1995", "1996", ["id", "status_of"])


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'removed' WHEN o_orderpriority = '2-HIGH' THEN 'added'
  ELSE 'changed' END AS status
FROM orders WHERE o_totalprice >= 400000"""
)
def range_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders stored twice, the dear ones removed, added or changed; only ranges with changes are read."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
    )
    dear = F.col("price") >= 400_000
    store = Store(spark, scratch_path(spark, "store"), [ORDERS], fresh=True, ranged={"orders_at": Ranges()})
    store.load("before", {"orders_at": rows.where(~dear | (F.col("priority") != "2-HIGH"))})
    after = rows.where(~dear | (F.col("priority") != "1-URGENT"))
    changed = dear & (F.col("priority") != "2-HIGH")
    store.load("after", {"orders_at": after.withColumn("price", F.when(changed, F.col("price") + 1).otherwise(F.col("price")))})
    return snapshots.diff_commits(store, "orders_at", "before", "after", ["id"])


@query("SELECT row_number() OVER (ORDER BY p_name || '.' || p_partkey) AS number, p_name || '.' || p_partkey AS name FROM part")
def list_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.lit(1).alias("tag"), F.lit("TypeSpec").alias("kind"), F.concat_ws(".", "p_name", "p_partkey").alias("data")
    )
    return snapshots.list_types(parts, tag=1)


def _func_decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as functions; those with a balance below zero have no receiver."""
    return table(spark, sf_dir, "customer").select(
        F.lit(1).alias("tag"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("receiver"),
    )


@query("SELECT row_number() OVER (ORDER BY c_name) AS number, c_name AS name FROM customer WHERE c_acctbal < 0")
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.list_functions(_func_decls(spark, sf_dir), tag=1)


@query(
    """SELECT row_number() OVER (ORDER BY c_mktsegment, c_name) AS number, c_mktsegment AS receiver, c_name AS name
FROM customer WHERE c_acctbal >= 0"""
)
def list_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.list_methods(_func_decls(spark, sf_dir), tag=1)


@query(
    """SELECT p_name AS name, p_type AS type, l_linenumber AS num, o_orderstatus AS kind
FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_name ILIKE '%RING%'"""
)
def func_link_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions by name pattern, their lines as body entries, orders as entry nodes."""
    tag = F.lit(1).alias("tag")
    functions = table(spark, sf_dir, "part").select(
        tag, F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("block_id")
    )
    links = table(spark, sf_dir, "lineitem").select(
        tag, F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("link_number"), F.col("l_orderkey").alias("link_id")
    )
    nodes = table(spark, sf_dir, "orders").select(
        tag, F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind")
    )
    return snapshots.functions_like(functions, links, nodes, "%RING%")


EVENTS = TableDef.of("events_at", Key("tag:INTEGER"), Key("id:INTEGER"), "user:INTEGER", "kind", "value:REAL")


@query("SELECT event_id AS id, user_id AS \"user\", event_type AS kind, value, 'events.parquet' AS commit_id FROM events")
def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files as commits, loaded by a stream; the stored table equals a batch load."""
    base = scratch_path(spark, "stream")
    store = Store(spark, f"{base}/store", [EVENTS], fresh=True)

    def build(batch: DataFrame) -> dict[str, DataFrame]:
        rows = batch.select(
            "commit_id", F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), "value"
        )
        return {"events_at": rows}

    for run in ("first", "again"):  # the second run sees the files anew and replaces their tag
        rows = file_stream(spark, sf_dir, SCHEMAS["events"], "events*.parquet")
        load_snapshots(rows, store, build, f"{base}/{run}")
    file = F.substring_index("commit_id", "/", -1).alias("commit_id")
    return store.read("events_at").join(store.tags().select("tag", file), "tag").drop("tag")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "stream")
    rows = file_stream(spark, sf_dir, SCHEMAS["events"], "events*.parquet").select("user_id", "event_type", "event_id")
    load_new_keys(rows, f"{base}/rows", ["user_id", "event_type"], f"{base}/checkpoint", ["event_id"])
    return read_new_keys(spark, f"{base}/rows", rows.schema).drop("batch")
