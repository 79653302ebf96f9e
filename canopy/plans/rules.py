"""Event rules, tables and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import lists, logic, macros, text
from canopy.operators.rules import (
    Case,
    CaseEmpty,
    Event,
    EventCase,
    EventCaseType,
    ForAll,
    ForPairs,
    Otherwise,
    Print,
    RuleSet,
    Store,
)
from canopy.operators import tables
from canopy.operators.tables import Key, TableDef
from canopy.plans.bindings import table
from canopy.plans.registry import query

MONEY = "decimal(18,2)"


@query("SELECT o_orderkey AS key, o_orderpriority AS priority, 'orders:' || o_orderkey AS place FROM orders WHERE o_orderstatus = 'F'")
def event_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event(F): store a member, another member and a location."""
    finished = TableDef.of("finished", Key("key:INTEGER"), "priority", "place")
    place = text.concat(F.lit("orders:"), text.stringify(F.col("o_orderkey")))
    rules = RuleSet(
        Event("F", Store(finished, F.col("o_orderkey"), F.col("o_orderpriority"), place)), kind=F.col("o_orderstatus")
    )
    return rules.apply(table(spark, sf_dir, "orders"))["finished"]


@query(
    """SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS "table", count(*) AS n,
  CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1"""
)
def event_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a receiver-like flag go to one table, all others to another."""
    returned = TableDef.of("returned", "part:INTEGER", "quantity:REAL")
    kept = TableDef.of("kept", "order:INTEGER", "quantity:REAL")
    receiver = F.when(F.col("l_returnflag") == "R", F.col("l_returnflag"))
    rules = RuleSet(
        EventCase(None)(logic.truthy(receiver, "string"), Store(returned, F.col("l_partkey"), F.col("l_quantity")))(
            Otherwise, Store(kept, F.col("l_orderkey"), F.col("l_quantity"))
        )
    )
    stored = rules.emit(table(spark, sf_dir, "lineitem"))
    quantity = F.coalesce("returned.quantity", "kept.quantity")
    return stored.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"), F.sum(quantity).cast("bigint").alias("quantity")
    )


@query(
    """SELECT CASE event_type WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'sales' ELSE 'others' END AS "table",
  count(*) AS n, CAST(sum(CASE event_type WHEN 'click' THEN user_id WHEN 'purchase' THEN event_id ELSE 1 END) AS BIGINT) AS total
FROM events GROUP BY 1"""
)
def case_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A switch with three branches on the kind of a member."""
    clicks = TableDef.of("clicks", "n:INTEGER")
    sales = TableDef.of("sales", "n:INTEGER", "value:REAL")
    others = TableDef.of("others", "n:INTEGER")
    rules = RuleSet(
        EventCaseType(None, F.col("event_type"))("click", Store(clicks, F.col("user_id")))(
            "purchase", Store(sales, F.col("event_id"), F.col("value"))
        )(Otherwise, Store(others, F.lit(1)))
    )
    stored = rules.emit(table(spark, sf_dir, "events"))
    number = F.coalesce("clicks.n", "sales.n", "others.n")
    return stored.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT 'unlinked' AS "table", page_id, CAST(NULL AS VARCHAR) AS href FROM p WHERE len(hrefs) = 0
UNION ALL SELECT 'linked', page_id, unnest(hrefs) FROM p
UNION ALL SELECT 'short', page_id, h FROM (SELECT page_id, unnest(hrefs) AS h FROM p) WHERE len(string_split(h, 'e')) = 1"""
)
def case_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch on an empty list, a loop over a list, and a branch on emptiness per element."""
    unlinked = TableDef.of("unlinked", "page:INTEGER")
    linked = TableDef.of("linked", "page:INTEGER", "href")
    short = TableDef.of("short", "page:INTEGER", "href")
    page = F.col("page_id")
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)

    def es(h):
        return F.regexp_extract_all(h, F.lit("e"), 0)

    rules = RuleSet(
        Event(
            None,
            CaseEmpty(F.col("hrefs"))(Store(unlinked, page))(
                Otherwise,
                ForAll(F.col("hrefs"), lambda h: [Store(linked, page, h), CaseEmpty(es(h))(Store(short, page, h))]),
            ),
        )
    )
    stored = rules.emit(table(spark, sf_dir, "pages").select("page_id", hrefs.alias("hrefs")))
    return stored.select(
        "table",
        F.coalesce("unlinked.page", "linked.page", "short.page").alias("page_id"),
        F.coalesce("linked.href", "short.href").alias("href"),
    )


@query(
    """WITH entries AS (
 SELECT 'orders_done' AS "table", CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'large', CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_totalprice > 250000
 UNION ALL SELECT 'purchases', CAST(value AS DECIMAL(18,2)) FROM events WHERE event_type = 'purchase')
SELECT "table", count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM entries GROUP BY 1"""
)
def analyze_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules on one kind and a rule on another, all targets filled by one scan."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("amount")
    )
    events = table(spark, sf_dir, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("state"), F.col("value").alias("amount")
    )
    done = TableDef.of("orders_done", Key("id:INTEGER"), "amount:REAL")
    large = TableDef.of("large", Key("id:INTEGER"), "state", "amount:REAL")
    purchases = TableDef.of("purchases", Key("id:INTEGER"), "amount:REAL")
    amount, state = F.col("amount"), F.col("state")
    rules = RuleSet(
        Event("order", Case()(state == "F", Store(done, F.col("id"), amount))),
        Event("order", Case()(amount > 250000, Store(large, F.col("id"), state, amount))),
        EventCase("event")(state == "purchase", Store(purchases, F.col("id"), amount)),
        kind=F.col("kind"),
    )
    stored = rules.emit(orders.unionByName(events))
    total = F.coalesce("orders_done.amount", "large.amount", "purchases.amount").cast(MONEY)
    return stored.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).cast("double").alias("amount")
    )


@query(
    """SELECT p_partkey AS part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS k, unnest(string_split(p_name, ' ')) AS v
FROM part"""
)
def for_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = TableDef.of("words", Key("part:INTEGER"), Key("k:INTEGER"), "v")
    rules = RuleSet(
        Event(None, ForPairs(text.split(F.col("p_name"), " "), lambda k, v: Store(words, F.col("p_partkey"), k, v)))
    )
    return rules.apply(table(spark, sf_dir, "part"))["words"]


@query(
    """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, nullif(p_type, 'SMALL') AS t,
  nullif(p_brand, 'Brand#2') AS b, p_size FROM part)
SELECT p_partkey, CAST(len(w) AS INTEGER) AS n_words, CAST(length(t) AS INTEGER) AS type_length,
  w[1] AS word0, w[2] AS word1, w[3] AS word2,
  coalesce(list_contains(w, 'red'), false) AS has_red,
  CASE WHEN list_position(w, 'ring') > 0 THEN CAST(list_position(w, 'ring') AS BIGINT) END AS ring_at,
  array_to_string(list_concat(w, CASE WHEN t IS NULL THEN [] ELSE [t] END), '+') AS appended,
  array_to_string(list_transform(list_filter(w, lambda x: x <> 'red'), lambda x: upper(x)), ',') AS mapped,
  CASE WHEN b IS NULL THEN 'none' ELSE 'brand' END AS merged,
  array_to_string(['base', 'size'], ',') AS key_list
FROM p"""
)
def list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, kind = F.col("w"), F.col("t")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        text.split(F.col("p_name"), " ").alias("w"),
        F.nullif("p_type", F.lit("SMALL")).alias("t"),
        F.nullif("p_brand", F.lit("Brand#2")).alias("b"),
        "p_size",
    )
    defaults = F.create_map(F.lit("base"), F.lit("none"), F.lit("size"), F.col("p_size").cast("string"))
    given = F.map_filter(
        F.create_map(F.lit("base"), F.when(F.col("b").isNotNull(), "brand")), lambda k, v: v.isNotNull()
    )
    merged = lists.merge(given, defaults)
    return part.select(
        "p_partkey",
        lists.length(words).alias("n_words"),
        lists.length(kind, "string").alias("type_length"),
        lists.index(words, 0).alias("word0"),
        lists.index(words, 1).alias("word1"),
        lists.index(words, 2).alias("word2"),
        lists.contains(words, "red").alias("has_red"),
        lists.index_of(words, "ring").alias("ring_at"),
        text.join("+", lists.append_all(words, F.when(kind.isNotNull(), F.array(kind)))).alias("appended"),
        text.join(",", lists.map_list(lambda w: F.when(w != "red", F.upper(w)), words)).alias("mapped"),
        merged["base"].alias("merged"),
        text.join(",", F.array_sort(lists.keys(merged))).alias("key_list"),
    )


@query(
    """WITH p AS (SELECT *, nullif(p_type, 'SMALL') AS t FROM part)
SELECT p_partkey, p_brand || ':' || t AS joined, repeat('-', p_size % 4) || p_name AS dashes,
  p_name AS base, '*' || p_name AS base2, CAST(p_size AS VARCHAR) AS stringified, 'parts.' || p_name AS qualified,
  array_to_string(list_filter(string_split(replace(p_brand || '#', '#', '#'), '#'), lambda x: x <> ''), '|') AS parts,
  p_name AS trimmed, array_to_string(string_split(p_name, ' '), ';') AS trimsplit,
  'part ' || p_partkey || ' is ${unknown} ' || coalesce(t, '') AS interpolated,
  'size <nil>' || '/' || coalesce(t, '<nil>') AS line
FROM p"""
)
def string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.nullif("p_type", F.lit("SMALL"))
    padded = F.concat(F.lit(" \t"), name, F.lit(" \n"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.concat(F.col("p_brand"), F.lit(":"), kind).alias("joined"),
        text.concat(text.repeat(F.lit("-"), F.col("p_size") % 4), name).alias("dashes"),
        text.basetype(F.concat(F.lit("*"), name)).alias("base"),
        text.basetype(F.concat(F.lit("**"), name)).alias("base2"),
        text.stringify(F.col("p_size")).alias("stringified"),
        text.qualified(F.lit("parts"), name).alias("qualified"),
        text.join("|", text.split(F.concat("p_brand", F.lit("#")), "#")).alias("parts"),
        text.trim(padded).alias("trimmed"),
        text.join(";", text.trimsplit(F.concat(F.lit(" "), F.regexp_replace(name, " ", " , ")), ",")).alias("trimsplit"),
        text.interpolate(
            "part ${key} is ${unknown} ${type}", {"key": F.col("p_partkey"), "type": F.coalesce(kind, F.lit(""))}
        ).alias("interpolated"),
        text.format_line("size %s/%s", F.lit(None), kind).alias("line"),
    )


@query(
    """WITH e AS (SELECT event_id, nullif(event_type, 'click') AS s, nullif(event_type, 'view') AS s2,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN false ELSE true END AS b,
  CASE WHEN event_type = 'signup' THEN NULL ELSE user_id % 2 END AS n, event_type FROM events),
 t AS (SELECT *, s IS NOT NULL AND s <> 'purchase' AS ts, coalesce(b, false) AS tb, n IS NOT NULL AS tn FROM
       (SELECT * REPLACE (CASE WHEN event_type = 'purchase' THEN '' ELSE s END AS s) FROM e))
SELECT event_id, s IS NOT NULL AND s <> '' AS true_s, tb AS true_b, tn AS true_n,
  NOT (s IS NOT NULL AND s <> '') AS not_s, NOT tb AS not_b,
  CASE WHEN s IS NOT NULL AND s <> '' THEN s2 ELSE s END AS s_and_s2,
  CASE WHEN s IS NOT NULL AND s <> '' THEN s ELSE s2 END AS s_or_s2,
  (s IS NOT NULL AND s <> '') <> (s2 IS NOT NULL AND s2 <> '') AS s_xor_s2,
  s IS NOT DISTINCT FROM s2 AS s_equal_s2
FROM t"""
)
def bool_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "purchase", "").otherwise(F.nullif(kind, F.lit("click"))).alias("s"),
        F.nullif(kind, F.lit("view")).alias("s2"),
        F.when(kind == "error", None).when(kind == "click", False).otherwise(True).alias("b"),
        F.when(kind != "signup", F.col("user_id") % 2).alias("n"),
    )
    s, s2, b, n = (F.col(c) for c in ("s", "s2", "b", "n"))
    return events.select(
        "event_id",
        logic.truthy(s, "string").alias("true_s"),
        logic.truthy(b, "boolean").alias("true_b"),
        logic.truthy(n).alias("true_n"),
        logic.not_(s, "string").alias("not_s"),
        logic.not_(b, "boolean").alias("not_b"),
        logic.and_(s, s2, "string").alias("s_and_s2"),
        logic.or_(s, s2, "string").alias("s_or_s2"),
        logic.xor(s, s2, "string").alias("s_xor_s2"),
        logic.equal(s, s2).alias("s_equal_s2"),
    )


@query(
    """SELECT c_custkey, upper(trim(c_name || ' ')) AS composed, 'c:' || c_mktsegment AS curried,
  lower(c_mktsegment) || c_name AS injected, lower(c_mktsegment) || lower(c_name) AS injected_all FROM customer"""
)
def macro_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    shout = macros.compose(F.upper, macros.compose(text.trim, lambda c: F.concat(c, F.lit(" "))))
    prefixed = macros.curry(F.concat, F.lit("c:"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        shout(name).alias("composed"),
        prefixed(segment).alias("curried"),
        macros.inject(F.concat, F.lower)(segment, name).alias("injected"),
        macros.inject_all(F.concat, F.lower)(segment, name).alias("injected_all"),
    )


@query(
    """WITH e AS (SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, value FROM events),
 stored AS (SELECT DISTINCT user_id, event_type FROM e WHERE event_type = 'signup')
SELECT min(event_id) AS event_id, user_id, event_type, arg_min(value, event_id) AS value FROM e
WHERE event_type IS NOT NULL AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM stored)
GROUP BY user_id, event_type
UNION ALL SELECT event_id, user_id, event_type, value FROM e WHERE event_type IS NULL"""
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by (user, type), the earliest wins; signups are there already; null types never collide."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "value"
    )
    keys = ["user_id", "event_type"]
    stored = tables.first_per_key(events.where(F.col("event_type") == "signup"), keys, ["event_id"])
    return tables.insert_ignore(stored, events, keys, ["event_id"])


@query(
    """SELECT p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, p_size > 25 AS large,
  '2020-01-02 03:04:05' AS seen FROM part
UNION ALL SELECT 'Foo', 12, NULL, true, '2020-01-02 03:04:00' UNION ALL SELECT NULL, NULL, 1.5, false, NULL"""
)
def table_def_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared table filled from expressions and from constants; values that do not fit become null."""
    items = TableDef.of("items", Key("name"), "size:INTEGER", "price:REAL", "large:BOOLEAN", "seen:TIMESTAMP")
    stored = items.store(
        table(spark, sf_dir, "part"),
        F.col("p_name"),
        F.col("p_size").cast("string"),
        F.col("p_retailprice").cast("string"),
        (F.col("p_size") > 25).cast("string"),
        F.lit("2020-01-02 03:04:05"),
    )
    constants = items.literal(
        spark, [("Foo", 12, "cheap", True, "2020-01-02T03:04"), (None, "many", 1.5, False, "yesterday")]
    )
    everything = stored.unionByName(constants)
    return everything.withColumn("seen", F.col("seen").cast("string"))


@query(
    """SELECT c_custkey AS id, 'Customer ' || c_name || ' has <nil> and ' || c_mktsegment || chr(10) AS line FROM customer
WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'ok' FROM customer WHERE c_acctbal >= 0"""
)
def print_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printf in a rule: formatted lines into a table next to the record's id."""
    lines = TableDef.of("lines", "id:INTEGER", "line")
    line = text.format_line("Customer %s has %s and %s\n", F.col("c_name"), F.lit(None), F.col("c_mktsegment"))
    rules = RuleSet(
        EventCase(None)(F.col("c_acctbal") < 0, Store(lines, F.col("c_custkey"), line))(
            Otherwise, Store(lines, F.col("c_custkey"), F.lit("ok"))
        ),
        Event(None, Print("seen %s", F.col("c_name"))),
    )
    return rules.apply(table(spark, sf_dir, "customer"))["lines"]
