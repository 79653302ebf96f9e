"""Event rules: what to store for each record of a kind.

A rule set is compiled to one array expression per record: each ``Store`` yields one tagged
entry, ``Case`` picks a branch, ``ForPairs`` maps its body over a list. One ``explode`` turns
the entries into rows, so all rules and all target tables share a single scan, without any
shuffle and without per-row Python.

    methods = TableDef.of("methods", Key("name"), "receiver")
    rules = RuleSet(
        EventCase("FuncDecl")
            (truthy(F.col("receiver")), Store(methods, F.col("name"), F.col("receiver")))
            (Otherwise, Store(functions, F.col("name"))),
        kind=F.col("kind"),
    )
    tables = rules.apply(nodes)          # {"methods": DataFrame, "functions": DataFrame}
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.lists import is_empty
from canopy.operators.tables import TableDef

Otherwise = Always = True


class Statement:
    def entries(self, targets: list[TableDef]) -> Column | None:
        """An array of entries for the wanted targets, or None if it stores to none of them."""
        raise NotImplementedError

    def tables(self) -> list[TableDef]:
        raise NotImplementedError


class Store(Statement):
    """Append one row to a table."""

    def __init__(self, table: TableDef, *values: Column):
        self.table, self.values = table, table.row(*values)

    def tables(self) -> list[TableDef]:
        return [self.table]

    def entries(self, targets: list[TableDef]) -> Column | None:
        if self.table not in targets:
            return None
        payload = [
            (F.struct(*self.values) if t == self.table else F.lit(None).cast(t.schema)).alias(t.name) for t in targets
        ]
        return F.array(F.struct(F.lit(self.table.name).alias("table"), *payload))


REPORT = TableDef.of("report", "line")


class Print(Store):
    """Append a formatted line to the ``report`` table."""

    def __init__(self, fmt: str, *values: Column):
        super().__init__(REPORT, F.format_string(fmt, *values) if values else F.lit(fmt))


class Case(Statement):
    """``Case()(cond, statement, ...)(cond, ...)(Otherwise, ...)``: the first true branch only."""

    def __init__(self, *branches: tuple[Column | bool, tuple[Statement, ...]]):
        self.branches = branches

    def __call__(self, condition: Column | bool, *statements: Statement) -> Case:
        return type(self)(*self.branches, (self.condition(condition), statements))

    def condition(self, condition: Column | bool) -> Column | bool:
        return condition

    def tables(self) -> list[TableDef]:
        return _tables(s for _, body in self.branches for s in body)

    def entries(self, targets: list[TableDef]) -> Column | None:
        bodies = [(c, _concat(body, targets)) for c, body in self.branches]
        if all(b is None for _, b in bodies):
            return None
        none = _nothing(targets)
        out, rest = None, none
        for condition, body in bodies:
            body = none if body is None else body
            if condition is True:
                rest = body
                break
            test = F.coalesce(condition, F.lit(False)) if isinstance(condition, Column) else F.lit(condition)
            out = F.when(test, body) if out is None else out.when(test, body)
        return rest if out is None else out.otherwise(rest)


def CaseType(value: Column) -> Case:
    """A case on the kind of a member: ``CaseType(kind)("StructType", ...)(Otherwise, ...)``."""

    class _CaseType(Case):
        def condition(self, condition):
            return condition if isinstance(condition, bool) else value.eqNullSafe(F.lit(condition))

    return _CaseType()


def CaseEmpty(value: Column) -> Callable[..., Case]:
    """A case whose first branch is taken for an empty or missing list."""
    return lambda *statements: Case()(is_empty(value), *statements)


class ForPairs(Statement):
    """Run statements for each element of a list, with its 1-based position.

    ``body(key, value)`` gets two columns and returns a statement or several.
    """

    def __init__(self, values: Column, body: Callable[[Column, Column], Statement | Iterable[Statement]]):
        self.values, self.body = values, body

    def _statements(self, key: Column, value: Column) -> list[Statement]:
        body = self.body(key, value)
        return [body] if isinstance(body, Statement) else list(body)

    def tables(self) -> list[TableDef]:
        return _tables(self._statements(F.lit(1), F.get(self.values, F.lit(0))))

    def entries(self, targets: list[TableDef]) -> Column | None:
        if not any(t in targets for t in self.tables()):
            return None
        stored = F.flatten(F.transform(self.values, lambda x, i: _concat(self._statements(i + 1, x), targets)))
        return F.coalesce(stored, _nothing(targets))


class ForAll(ForPairs):
    """Run statements for each element of a list: ``body(value)``."""

    def __init__(self, values: Column, body: Callable[[Column], Statement | Iterable[Statement]]):
        super().__init__(values, lambda _, v: body(v))


class Event(Statement):
    """Run statements for each record of a kind; ``kind=None`` means every record."""

    def __init__(self, kind: str | None, *statements: Statement):
        self.kind, self.statements = kind, statements

    def tables(self) -> list[TableDef]:
        return _tables(self.statements)

    def entries(self, targets: list[TableDef]) -> Column | None:
        return _concat(self.statements, targets)


class EventCase(Event):
    """An event holding one case: ``EventCase(kind)(cond, ...)(cond, ...)``."""

    def __init__(self, kind: str | None, case: Case | None = None):
        self.case = case or Case()
        super().__init__(kind, self.case)

    def __call__(self, condition, *statements: Statement) -> EventCase:
        return EventCase(self.kind, self.case(condition, *statements))


def EventCaseType(kind: str | None, member: Column) -> EventCase:
    """An event with a case on the kind of a member."""
    return EventCase(kind, CaseType(member))


class RuleSet:
    """Rules in firing order; ``kind`` is the column that holds a record's kind."""

    def __init__(self, *events: Event, kind: Column | None = None):
        if kind is None and any(e.kind is not None for e in events):
            raise ValueError("events name a kind, but the rule set has no kind column")
        self.events, self.kind = events, kind

    def targets(self) -> list[TableDef]:
        return _tables(self.events)

    def emit(self, df: DataFrame, only: Iterable[TableDef] | None = None) -> DataFrame:
        """One row per stored row: ``table`` and one struct column per target, the others null.

        Records no rule looks at are filtered out in front, so the test on ``kind`` reaches
        the file scan.
        """
        wanted = self.targets() if only is None else list(only)
        bodies = [(e, e.entries(wanted)) for e in self.events]
        bodies = [(e, b) for e, b in bodies if b is not None]
        if not bodies:
            raise ValueError("no rule stores to the wanted tables")
        kinds = {e.kind for e, _ in bodies}
        if None not in kinds:
            df = df.where(self.kind.isin(sorted(kinds)))
        none = _nothing(wanted)
        fired = [
            b if e.kind is None or len(kinds) == 1 else F.when(self.kind == e.kind, b).otherwise(none) for e, b in bodies
        ]
        entries = fired[0] if len(fired) == 1 else F.concat(*fired)
        return df.select(F.explode(entries).alias("_entry")).select("_entry.*")

    def apply(self, df: DataFrame) -> dict[str, DataFrame]:
        """One DataFrame per target table, each with its own pruned and filtered scan."""
        return {
            t.name: self.emit(df, [t]).where(F.col("table") == t.name).select(f"{t.name}.*") for t in self.targets()
        }

    def write(self, df: DataFrame, path: str) -> dict[str, DataFrame]:
        """Store all targets with a single pass over ``df``: one write, one folder per table."""
        self.emit(df).write.partitionBy("table").parquet(path)
        spark = df.sparkSession
        rows = spark.read.parquet(path) if self.targets() else None
        return {
            t.name: rows.where(F.col("table") == t.name).select(f"{t.name}.*") for t in self.targets()
        }


def _nothing(targets: list[TableDef]) -> Column:
    """An empty array of entries."""
    entry = T.StructType([T.StructField("table", T.StringType()), *[T.StructField(t.name, t.schema) for t in targets]])
    return F.array().cast(T.ArrayType(entry))


def _tables(statements: Iterable[Statement]) -> list[TableDef]:
    found: dict[str, TableDef] = {}
    for s in statements:
        for t in s.tables():
            if found.setdefault(t.name, t) != t:
                raise ValueError(f"two tables are named {t.name}")
    return list(found.values())


def _concat(statements: Iterable[Statement], targets: list[TableDef]) -> Column | None:
    parts = [e for e in (s.entries(targets) for s in statements) if e is not None]
    if not parts:
        return None
    return reduce(lambda a, b: F.concat(a, b), parts)
