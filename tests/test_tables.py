import datetime

import pytest
from pyspark.sql import functions as F

from canopy.operators.numbering import number_rows
from canopy.operators.tables import Key, TableDef, first_per_key, insert_ignore, to_timestamp


def test_declaration(spark):
    t = TableDef.of("t", Key("a:INTEGER"), Key("b"), "c:REAL", "d:BOOLEAN")
    assert t.keys == ("a", "b")
    assert t.empty(spark).schema.simpleString() == "struct<a:bigint,b:string,c:double,d:boolean>"


@pytest.mark.parametrize("bad", ["a b", "x;drop", "", "a-b"])
def test_names_are_checked(bad):
    with pytest.raises(ValueError):
        TableDef.of(bad, "x")
    with pytest.raises(ValueError):
        TableDef.of("t", bad)


def test_unknown_type_and_double_field():
    with pytest.raises(ValueError):
        TableDef.of("t", "a:COMPLEX")
    with pytest.raises(ValueError):
        TableDef.of("t", "a", "a:INTEGER")


def test_literal_rows(spark, rows):
    t = TableDef.of("MyTable", Key("Name"), Key("Location"), "size:INTEGER")
    assert rows(t.literal(spark, [("Foo", "Oshawa", 1), ("Bar", None, "x")])) == [("Bar", None, None), ("Foo", "Oshawa", 1)]
    with pytest.raises(ValueError):
        t.literal(spark, [("Foo",)])


def test_time_texts(spark):
    texts = [
        "2020-01-02 03:04:05.123456789", "2020-01-02T03:04:05.5", "2020-01-02 03:04:05", "2020-01-02T03:04:05",
        "2020-01-02 03:04", "2020-01-02T03:04", "2020-01-02", "1577934245", "soon", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.select("i", to_timestamp(F.col("t")).cast("string").alias("s")).orderBy("i").collect()]
    assert got[0] == "2020-01-02 03:04:05.123456" and got[2] == got[3] == "2020-01-02 03:04:05"
    assert got[1] == "2020-01-02 03:04:05.5"
    assert got[4] == got[5] == "2020-01-02 03:04:00" and got[6] == "2020-01-02 00:00:00"
    assert got[7] == "2020-01-02 03:04:05" and got[8] is None and got[9] is None


def test_first_row_of_a_key_wins_and_null_keys_never_collide(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 5, "x"), (1, "a", 3, "y"), (1, None, 1, "p"), (1, None, 1, "p"), (2, "a", None, "q"), (2, "a", 1, "r")],
        "k int, l string, o int, v string",
    )
    got = rows(first_per_key(df, ["k", "l"], ["o"]))
    assert got == [(1, None, 1, "p"), (1, None, 1, "p"), (1, "a", 3, "y"), (2, "a", None, "q")]


def test_insert_ignore_keeps_stored_rows(spark, rows):
    stored = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert rows(insert_ignore(stored, new, ["k"])) == [(2, "a")]


def test_key_only_table(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert rows(first_per_key(df, ["k"])) == [(None,), (None,), (1,)]


def test_numbering_of_a_whole_table(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(7)
    got = {r["v"]: r["number"] for r in number_rows(df, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(1000)}


@pytest.mark.parametrize("heavy_rows", [1_000_000, 50])
def test_numbering_within_groups(spark, heavy_rows):
    df = spark.range(900).selectExpr("if(id % 3 = 0, -1, id % 5) AS g", "(id * 7919) % 900 AS v").repartition(5)
    want = {}
    for g, v in sorted((r["g"], r["v"]) for r in df.collect()):
        want[g, v] = sum(1 for k in want if k[0] == g) + 1
    got = {(r["g"], r["v"]): r["n"] for r in number_rows(df, ["v"], ["g"], "n", heavy_rows).collect()}
    assert got == want


def test_numbering_of_nothing(spark):
    assert number_rows(spark.range(0), ["id"]).count() == 0


def test_date_values(spark):
    t = TableDef.of("t", "d:DATE")
    assert t.literal(spark, [("2020-02-03",)]).first()["d"] == datetime.date(2020, 2, 3)
