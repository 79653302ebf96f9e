"""Source text to tables to satisfaction, over texts written for these tests."""

import pytest
from pyspark.sql import functions as F

from canopy.operators.catalog import FUNC_DECL, SATISFACTION_TABLES, kind_table
from canopy.operators.rules import Event, RuleSet
from canopy.operators.rules import Store as StoreRow
from canopy.operators.satisfy import satisfaction
from canopy.sources.analyze import analyze
from canopy.sources.declarations import declaration_rules, declarations, unsupported
from canopy.sources.files import find_files, find_packages, read_sources
from canopy.sources.store import Store

SHAPES = """package shapes

import "fmt"

// Figure is what can be drawn.
type Figure interface {
\tDraw()
\tScale(int) int // by a factor
}

type Dot int
type Line int
type Area int

func (_ Dot) Draw()  {}
func (_ Line) Draw() {}

func (_ Dot) Scale(_ int) int  { return 1 }
func (_ Area) Scale(_ int) int { return 1 }

type Base struct {
\twidth, height int
}

func (_ Base) Draw() {}

type Solid struct {
\tBase
\tname string `json:"name"`
}

func (s Solid) Scale(by int) int {
\tfmt.Println(by)
\treturn by
}

func helper(a, b int, rest ...string) (n int, err error) {
\treturn
}
"""

RESULTS = """package results

type Low struct{ level int }
type High struct{ label string }

func (l *Low) Grade() uint8    { return 3 }
func (h *High) Grade() float64 { return 0.5 }

type ByteGrader interface{ Grade() uint8 }
type FloatGrader interface{ Grade() float64 }
"""

RECEIVERS = """package receivers

type Meter float64

func (m Meter) Read() {}
func (m *Meter) Reset() {}

type Readable interface {
\tRead()
}
type Device interface {
\tReset()
\tRead()
}
type Nested interface { Device; Readable }

type Panel struct {
\tMeter
}
type Remote struct {
\t*Meter
}
type Shell struct { Readable }
"""

WIDTHS = """package widths

type Weigher interface { Grams(scale float64) int }

type Crate struct { boxes, lids int }
func (c *Crate) Grams(s float64) int { return c.boxes + c.lids }
type Coin uint16
func (c *Coin) Grams(s float64) int { return 7 }
type Sack struct { full bool }
func (k Sack) Grams(s float64) int { return 900 }
type Grain uint8
func (g Grain) Grams(s float64) int { return 1 }
"""

CONVERSIONS = """package conversions

type Titled interface {
\tTitle() string
}
type Priced interface {
\tTitle() string
\tCents(tax bool) int
}
type Whatever interface{}

type Book string

func (b Book) Title() string {
\treturn "a book"
}
func (b Book) Cents(withTax bool) int {
\treturn 1999
}

type Leaflet []byte

func (l Leaflet) Title() string {
\treturn "a leaflet"
}
"""

HELD = """package held

type Opener interface { Open(path string) error }
type Door uint
func (d Door) Open(path string) error { return nil }
type House struct { Opener }
type Tent struct { *Opener }
"""

NOTHING = """package nothing

type Boiler interface { Boil() }
type Kettle interface { Boil(); Pour() }
type Cup struct {
}
func pourAll() {
}
"""

MANY = """package many

type Mover interface { Move(dx int, dir string) }
type Stopper interface { Stop() }
type Car struct { wheels int }
type Cart struct {
\tlength, width int
}
type Sign struct{ text string }
func (Car) Move(_ int, _ string) {}
func (c *Cart) Move(steps int, to string) { }
func (s Sign) Stop() {}
"""

GOLDEN = [
    (
        WIDTHS,
        [("Coin", "Weigher"), ("Crate", "Weigher"), ("Grain", "Weigher"), ("Sack", "Weigher")],
        [("Crate", "Weigher"), ("Sack", "Weigher")],
    ),
    (CONVERSIONS, [("Book", "Priced"), ("Book", "Titled"), ("Leaflet", "Titled")], []),
    (HELD, [("Door", "Opener")], []),
    (NOTHING, [], []),
    (MANY, [("Car", "Mover"), ("Cart", "Mover"), ("Sign", "Stopper")], [("Car", "Mover"), ("Cart", "Mover"), ("Sign", "Stopper")]),
]

ODD = """package odd

type (
\tGrouped int
)

func callback(f func(g func(int) int) int) {}

func fine(m map[string]int, c chan int, x interface{}) [4]byte { return nil }
"""


def analysed(spark, text, params_only=False):
    sources = spark.createDataFrame([("a/f.go", text)], "path string, content string")
    return declaration_rules().apply(declarations(sources, params_only))


def satisfied(spark, rows, text, structs_only=False, embed=True, **kw):
    t = analysed(spark, text, **kw)
    owners = t["structs"].select("type") if structs_only else t["types"].select(F.col("name").alias("type"))
    inherits = [t["struct_inherits"], t["interface_inherits"]] if embed else []
    got = satisfaction(owners, t["methods"], t["interfaces"], t["interface_reqs"], *inherits)
    return [(a.split(".")[1], b.split(".")[1]) for a, b in rows(got)]


def test_tables_of_a_file(spark, rows):
    t = analysed(spark, SHAPES)
    assert rows(t["functions"]) == [("helper", "func(int, int, ...string) (int, error)", "a/f.go:37:1")]
    assert ("Scale", "func(int) int", "shapes.Solid", "a/f.go:32:1") in rows(t["methods"])
    assert len(rows(t["methods"])) == 6
    assert rows(t["structs"]) == [("shapes.Base", "a/f.go:21:6"), ("shapes.Solid", "a/f.go:27:6")]
    assert rows(t["interfaces"]) == [("shapes.Figure", "a/f.go:6:6")]
    assert rows(t["interface_reqs"]) == [
        ("shapes.Figure", "Draw", "func()", "a/f.go:7:2"),
        ("shapes.Figure", "Scale", "func(int) int", "a/f.go:8:2"),
    ]
    assert rows(t["struct_inherits"]) == [("shapes.Solid", "shapes.Base")]
    assert len(rows(t["types"])) == 6


def test_satisfaction_with_and_without_embedding(spark, rows):
    assert satisfied(spark, rows, SHAPES) == [("Dot", "Figure"), ("Solid", "Figure")]
    assert satisfied(spark, rows, SHAPES, structs_only=True) == [("Solid", "Figure")]
    assert satisfied(spark, rows, SHAPES, embed=False) == [("Dot", "Figure")]
    assert satisfied(spark, rows, SHAPES, structs_only=True, embed=False) == []


def test_results_are_part_of_a_signature(spark, rows):
    assert satisfied(spark, rows, RESULTS) == [("High", "FloatGrader"), ("Low", "ByteGrader")]
    both = satisfied(spark, rows, RESULTS, params_only=True)
    assert both == [(o, c) for o in ("High", "Low") for c in ("ByteGrader", "FloatGrader")]


def test_receivers_and_embedded_contracts(spark, rows):
    got = satisfied(spark, rows, RECEIVERS)
    owners = ("Meter", "Panel", "Remote")
    assert got == sorted((o, c) for o in owners for c in ("Readable", "Device", "Nested"))  # Shell gains nothing


@pytest.mark.parametrize("text, every_type, structs", GOLDEN)
def test_golden_satisfactions(spark, rows, text, every_type, structs):
    assert satisfied(spark, rows, text) == every_type
    assert satisfied(spark, rows, text, structs_only=True) == structs


def test_analyze_stores_all_targets(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "store"), SATISFACTION_TABLES, fresh=True)
    sources = spark.createDataFrame([("a.go", SHAPES), ("b.go", MANY)], "path string, content string")
    for _ in range(2):  # known keys are kept, so a second run changes nothing
        analyze(declarations(sources), declaration_rules(), store)
    counts = {t.name: store.read(t.name).count() for t in SATISFACTION_TABLES}
    assert counts["methods"] == 9 and counts["types"] == 11 and counts["struct_inherits"] == 1
    got = store.query(
        "SELECT receiver_type FROM methods m JOIN interface_reqs r USING (name, type) WHERE r.interface = ?", "many.Mover"
    )
    assert rows(got) == [("many.Car",), ("many.Cart",)]


def test_analyze_replaces_a_commit(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "store"), [FUNC_DECL], fresh=True)
    records = declarations(spark.createDataFrame([("a.go", SHAPES)], "path string, content string"))
    nil = F.lit(None)
    rules = RuleSet(
        Event("FuncDecl", StoreRow(FUNC_DECL, nil, F.xxhash64("location"), F.col("location"), nil, F.col("name"), F.col("receiver"), F.col("type"), nil)),
        kind=F.col("kind"),
    )
    with pytest.raises(ValueError):
        analyze(records, rules, store)
    assert analyze(records, rules, store, "c1") == 1 and analyze(records, rules, store, "c1") == 2
    assert store.read("FuncDecl").count() == 7
    assert rows(store.read("FuncDecl").where("receiver IS NULL"), "tag", "name") == [(2, "helper")]


def test_wide_kind_table_definition():
    table = kind_table("BinaryExpr", ["typeof"], ["X", "Y"])
    assert table.columns == ["tag", "id", "location", "typeof", "X_id", "Y_id"] and table.keys == ("tag", "id")


def test_unsupported_declarations_are_listed(spark, rows):
    found = declarations(spark.createDataFrame([("o.go", ODD)], "path string, content string"))
    assert rows(unsupported(found), "line") == [(3,), (7,)]
    nested = declarations(spark.createDataFrame([("n.go", "package n\n\nfunc once(f func(int, bool) int, k string) {}")], "path string, content string"))
    assert rows(nested, "type") == [("func(func(int, bool) int, string)",)]
    assert rows(found.where(F.col("name") == "fine"), "type") == [("func(map[string]int, chan int, interface{}) [4]byte",)]


def test_text_without_a_package_is_not_guessed_at(spark, rows):
    found = declarations(spark.createDataFrame([("x.go", "func a() {}\n")], "path string, content string"))
    assert found.where(F.col("kind").isNotNull()).count() == 0 and unsupported(found).count() == 1


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a/one.go": SHAPES, "a/b/two.go": RESULTS, "a/b/notes.txt": "x"}.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return tmp_path


def test_find_and_read_files(spark, rows, folder):
    files = find_files(spark, str(folder), "*.go")
    assert [p.rsplit("/", 1)[1] for (p,) in rows(files, "path")] == ["two.go", "one.go"]
    assert find_files(spark, str(folder), "*.go", F.col("path").contains("/b/")).count() == 1
    assert [f.rsplit("/", 1)[1] for (f,) in rows(find_packages(files))] == ["a", "b"]
    sources = read_sources(spark, [str(folder / "a" / "b"), str(folder / "a" / "one.go")], "*.go")
    assert sources.count() == 2
    types = declaration_rules().apply(declarations(sources))["types"]
    assert types.count() == 6 + 4


STRICT = """package walk

/* Old code:
func Ghost() {}
type Gone struct {}
*/
type Walker interface {
\tName() string
\tWalk(fn func(int, string) error, depth int) error
}

type Odd interface {
\tName() string
\tDeep(f func(g func(int) int) int)
}

type T struct{ n int }

func (t T) Name() string { return `
func InString() {}
` }

type Full struct{ n int }

func (f Full) Name() string { return "/*" }
func (f Full) Walk(g func(int, string) error, n int) error { return nil }
"""


def test_contracts_are_not_weakened_and_comments_are_no_code(spark, rows, tmp_path):
    (tmp_path / "walk.go").write_text(STRICT)
    declared = declarations(read_sources(spark, str(tmp_path), "*.go"))
    store = Store(spark, str(tmp_path / "store"), SATISFACTION_TABLES, fresh=True)
    analyze(declared, declaration_rules(), store)
    t = {name: store.read(name) for name in store.tables}
    assert rows(t["functions"], "name") == []
    assert rows(t["types"], "name") == [("walk.Full",), ("walk.Odd",), ("walk.T",), ("walk.Walker",)]
    assert ("walk.Walker", "Walk", "func(func(int, string) error, int) error") in rows(t["interface_reqs"], "interface", "name", "type")
    pairs = satisfaction(t["structs"], t["methods"], t["interfaces"], t["interface_reqs"], t["struct_inherits"], t["interface_inherits"])
    assert rows(pairs) == [("walk.Full", "walk.Walker")]
    assert rows(unsupported(declared), "member") == [("Deep(f func(g func(int) int) int)",)]
