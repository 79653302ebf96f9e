import pytest
from pyspark.sql import functions as F

from canopy.functions.logic import truthy
from canopy.operators.rules import (
    Case,
    CaseEmpty,
    CaseType,
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
from canopy.operators.tables import Key, TableDef

NAMED = TableDef.of("named", Key("name"))
PAIRS = TableDef.of("pairs", "id:INTEGER", "k:INTEGER", "v")


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(
        [(1, "Func", "f", "r", ["a", "b"]), (2, "Func", "g", None, []), (3, "Type", "t", "", None)],
        "id int, kind string, name string, receiver string, items array<string>",
    )


def test_first_true_branch_only(rows, nodes):
    low, high = TableDef.of("low", "id:INTEGER"), TableDef.of("high", "id:INTEGER")
    case = Case()(F.col("id") < 2, Store(low, F.col("id")))(F.col("id") < 3, Store(high, F.col("id")))
    got = RuleSet(Event(None, case)).apply(nodes)
    assert rows(got["low"]) == [(1,)] and rows(got["high"]) == [(2,)]


def test_null_condition_is_false(rows, nodes):
    a, b = TableDef.of("a", "id:INTEGER"), TableDef.of("b", "id:INTEGER")
    rules = RuleSet(EventCase("Func")(F.col("receiver") == "r", Store(a, F.col("id")))(Otherwise, Store(b, F.col("id"))), kind=F.col("kind"))
    got = rules.apply(nodes)
    assert rows(got["a"]) == [(1,)] and rows(got["b"]) == [(2,)]


def test_all_rules_of_a_kind_fire_in_order(rows, nodes):
    rules = RuleSet(
        Event("Func", Store(NAMED, F.col("name")), Store(NAMED, F.upper("name"))),
        Event("Func", Print("%s!", F.col("name"))),
        Event("Type", Store(NAMED, F.col("name"))),
        kind=F.col("kind"),
    )
    got = rules.apply(nodes)
    assert rows(got["named"]) == [("F",), ("G",), ("f",), ("g",), ("t",)]
    assert rows(got["report"]) == [("f!",), ("g!",)]
    order = [r["table"] for r in rules.emit(nodes.where("id = 1")).collect()]
    assert order == ["named", "named", "report"]


def test_loops_have_one_based_keys_and_skip_missing_lists(rows, nodes):
    loop = ForPairs(F.col("items"), lambda k, v: Store(PAIRS, F.col("id"), k, v))
    assert rows(RuleSet(Event(None, loop)).apply(nodes)["pairs"]) == [(1, 1, "a"), (1, 2, "b")]


def test_nested_loops_and_cases(rows, spark):
    df = spark.createDataFrame([(1, [["x", "y"], [], ["z"]])], "id int, lists array<array<string>>")
    empty = TableDef.of("empty", "id:INTEGER")
    rule = ForPairs(
        F.col("lists"),
        lambda i, inner: CaseEmpty(inner)(Store(empty, i))(
            Otherwise, ForAll(inner, lambda v: Case()(v != "y", Store(PAIRS, F.col("id"), i, v)))
        ),
    )
    got = RuleSet(Event(None, rule)).apply(df)
    assert rows(got["pairs"]) == [(1, 1, "x"), (1, 3, "z")] and rows(got["empty"]) == [(2,)]


def test_missing_list_in_one_rule_does_not_lose_the_rows_of_another(rows, nodes):
    loop = Case()(F.col("id") > 2, ForAll(F.col("items"), lambda v: Store(PAIRS, F.col("id"), F.lit(0), v)))
    rules = RuleSet(Event(None, Store(NAMED, F.col("name")), loop))
    assert rows(rules.emit(nodes), "named.name") == [("f",), ("g",), ("t",)]


def test_case_on_the_kind_of_a_member(rows, nodes):
    a, b = TableDef.of("a", "id:INTEGER"), TableDef.of("b", "id:INTEGER")
    typed = EventCaseType("Func", F.col("receiver"))("r", Store(a, F.col("id")))(Otherwise, Store(b, F.col("id")))
    inner = Event("Type", CaseType(F.col("name"))("t", Store(b, F.col("id") * 10)))
    got = RuleSet(typed, inner, kind=F.col("kind")).apply(nodes)
    assert rows(got["a"]) == [(1,)] and rows(got["b"]) == [(2,), (30,)]


def test_branch_without_a_store_swallows_the_record(rows, nodes):
    other = TableDef.of("other", "id:INTEGER")
    rules = RuleSet(Event(None, Case()(truthy(F.col("receiver"), "string"))(Otherwise, Store(other, F.col("id")))))
    assert rows(rules.apply(nodes)["other"]) == [(2,), (3,)]


def test_one_scan_for_all_targets_and_kind_filter_in_front(nodes):
    rules = RuleSet(
        Event("Func", Store(NAMED, F.col("name")), Store(PAIRS, F.col("id"), F.lit(1), F.col("name"))), kind=F.col("kind")
    )
    plan = rules.emit(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Exchange" not in plan


def test_write_stores_all_targets_in_one_pass(spark, rows, nodes, tmp_path):
    rules = RuleSet(
        Event("Func", Store(NAMED, F.col("name")), ForPairs(F.col("items"), lambda k, v: Store(PAIRS, F.col("id"), k, v))),
        kind=F.col("kind"),
    )
    got = rules.write(nodes, str(tmp_path / "out"))
    assert rows(got["named"]) == [("f",), ("g",)] and rows(got["pairs"]) == [(1, 1, "a"), (1, 2, "b")]


def test_wrong_number_of_values():
    with pytest.raises(ValueError):
        Store(NAMED, F.lit("a"), F.lit("b"))
