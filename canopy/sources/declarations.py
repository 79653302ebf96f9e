"""Top-level declarations out of source text, with built-in column functions only.

Covers text laid out the standard way: a top-level declaration starts in the first column and
a type body closes with ``}`` in the first column. Each file is one row and stays within it:
lines, declarations and members are array expressions, so nothing is shuffled. Block comments and
raw strings are blanked out first, keeping lines and columns. Declarations and contract members
outside the covered subset are not guessed at; they are listed by ``unsupported``, and a contract
with such a member asks for an item that nothing offers, so that it is never weakened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.logic import truthy
from canopy.functions.text import basetype, location, qualified, trim
from canopy.operators.rules import Case, Event, ForAll, RuleSet, Store
from canopy.operators.tables import Key, TableDef

METHODS = TableDef.of("methods", Key("name"), Key("type"), Key("receiver_type"), "location")
FUNCTIONS = TableDef.of("functions", Key("name"), Key("type"), "location")
STRUCTS = TableDef.of("structs", Key("type"), "location")
INTERFACES = TableDef.of("interfaces", Key("interface"), "location")
INTERFACE_REQS = TableDef.of("interface_reqs", Key("interface"), Key("name"), Key("type"), "location")
INTERFACE_INHERITS = TableDef.of("interface_inherits", Key("type"), Key("embedded_type"))
STRUCT_INHERITS = TableDef.of("struct_inherits", Key("type"), Key("embedded_type"))
TYPES = TableDef.of("types", Key("name"), "location")

# Predeclared type names and words that begin a type (fixed values): never qualified.
PREDECLARED = (
    "bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string "
    "uint uint8 uint16 uint32 uint64 uintptr"
).split()
TYPE_WORDS = "chan func interface map struct".split()

_NAME = r"[A-Za-z_]\w*"
# A list in brackets; brackets inside it, as in a parameter that is a function, may nest once.
_LIST = r"((?:[^()]|\([^()]*\))*)"
_RESULT = rf"(\({_LIST.replace('((', '(?:(', 1)}\)|(?:interface\{{\}}|struct\{{\}}|[^{{(])*?)"
_FUNC = rf"^func\s+(?:\(\s*(?:{_NAME}\s+)?(\*?[\w.]+)\s*\)\s*)?({_NAME})\({_LIST}\)\s*{_RESULT}\s*(?:\{{.*)?$"
_TYPE = rf"^type\s+({_NAME})\s+(.*?)\s*$"
_REQUIREMENT = rf"^({_NAME})\({_LIST}\)\s*{_RESULT}$"
# Comments, strings and the text between them.
_PIECES = r"""/\*[\s\S]*?(?:\*/|\z)|`[^`]*(?:`|\z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|[^/`"']+|/"""
_OTHER = "unsupported"
_EMBEDDED = r"^\*?[A-Za-z_][\w.]*$"
_LOCAL_NAME = rf"(?<![\w.])(?!(?:{'|'.join(PREDECLARED + TYPE_WORDS)})\b)({_NAME})(?![\w.])"


def type_text(text: Column, package: Column) -> Column:
    """Canonical type text: names declared in the file's package are qualified with it."""
    return F.regexp_replace(trim(text), F.lit(_LOCAL_NAME), F.concat(package, F.lit(".$1")))


def type_list(text: Column, package: Column) -> Column:
    """Types of a parameter list: names dropped, ``a, b T`` counted as two T."""
    pieces = F.filter(F.transform(F.split(text, r",(?![^()]*\))"), trim), lambda p: p != "")
    words = "|".join(TYPE_WORDS)

    def named(p: Column) -> Column:
        return p.rlike(rf"^(?!(?:{words})\b){_NAME}\s+\S")

    # A bare name takes the type of the next piece that has one, so fill from the right.
    filled = F.aggregate(
        F.reverse(pieces),
        F.struct(F.array().cast("array<string>").alias("types"), F.lit("").alias("last")),
        lambda acc, p: F.struct(
            F.concat(
                F.array(F.when(named(p), F.regexp_replace(p, rf"^{_NAME}\s+", "")).otherwise(acc["last"])), acc["types"]
            ).alias("types"),
            F.when(named(p), F.regexp_replace(p, rf"^{_NAME}\s+", "")).otherwise(acc["last"]).alias("last"),
        ),
        lambda acc: acc["types"],
    )
    return F.transform(F.when(F.exists(pieces, named), filled).otherwise(pieces), lambda t: type_text(t, package))


def signature(params: Column, results: Column, package: Column, params_only: bool = False) -> Column:
    """Canonical function type: ``func(int, *pkg.T) (string, error)``.

    ``params_only`` leaves the results out, which makes functions that differ only in their
    results equal.
    """
    head = F.concat(F.lit("func("), F.array_join(type_list(params, package), ", "), F.lit(")"))
    if params_only:
        return head
    inner = F.regexp_replace(trim(results), r"^\(|\)$", "")
    types = type_list(inner, package)
    return F.concat(
        head,
        F.when(F.size(types) == 0, "")
        .when(F.size(types) == 1, F.concat(F.lit(" "), F.get(types, F.lit(0))))
        .otherwise(F.concat(F.lit(" ("), F.array_join(types, ", "), F.lit(")"))),
    )


def without_comments(content: Column) -> Column:
    """Text with block comments and raw strings blanked out; every other character keeps its place."""
    blank = lambda p: F.regexp_replace(p, r"[^\r\n]", " ")
    pieces = F.regexp_extract_all(content, F.lit(_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("/*") | p.startswith("`"), blank(p)).otherwise(p)), "")


def declarations(sources: DataFrame, params_only: bool = False) -> DataFrame:
    """Declarations of source files (path, content), one row each.

    Columns: path, package, line, kind (FuncDecl, TypeSpec or null when unsupported), name,
    receiver, type, type_kind (StructType, InterfaceType, Other), location, members. A member
    is (name, type, embedded, location): a required method, or an embedded type. A member of a
    contract that is neither has its text as name and the type ``unsupported``.
    """
    sources = sources.withColumn("content", without_comments(F.col("content")))
    lines = F.split("content", r"\r?\n")
    package = F.regexp_extract("content", rf"(?m)^package\s+({_NAME})", 1)
    opened = sources.select("path", lines.alias("lines"), package.alias("package"))
    closing = F.filter(
        F.transform("lines", lambda s, i: F.when(s.rlike(r"^\}"), i)), lambda i: i.isNotNull()
    )
    opened = opened.withColumn("closing", closing)

    def declaration(head: Column, i: Column) -> Column:
        end = F.get(F.filter("closing", lambda e: e > i), F.lit(0))
        multi = head.rlike(r"^type\s.*\{\s*(//.*)?$") & end.isNotNull()
        body = F.when(multi, F.slice("lines", i + 2, F.greatest(end - i - 1, F.lit(0))))
        return F.when(
            head.rlike(r"^(func|type)\s"),
            F.struct((i + 1).alias("line"), head.alias("head"), body.alias("body")),
        )

    found = opened.select(
        "path", "package", F.explode(F.array_compact(F.transform("lines", declaration))).alias("d")
    ).select("path", "package", "d.*")

    head = F.regexp_replace("head", r"\s*//.*$", "")
    found = found.withColumn("head", head)
    pkg, place = F.col("package"), F.col("line")

    def group(pattern: str, n: int, of: Column | str = "head") -> Column:
        return F.regexp_extract(of, pattern, n)

    is_func = F.col("head").rlike(_FUNC) & (pkg != "")
    is_type = F.col("head").rlike(_TYPE) & ~F.col("head").rlike(r"^type\s*\(") & (pkg != "")
    spec = group(_TYPE, 2)
    found = found.select(
        "*",
        F.when(is_func, "FuncDecl").when(is_type, "TypeSpec").alias("kind"),
        F.when(is_func, group(_FUNC, 2)).when(is_type, qualified(pkg, group(_TYPE, 1))).alias("name"),
        F.when(is_func & (group(_FUNC, 1) != ""), type_text(group(_FUNC, 1), pkg)).alias("receiver"),
        F.when(is_func, signature(group(_FUNC, 3), group(_FUNC, 4), pkg, params_only))
        .when(is_type & ~spec.rlike(r"\{"), type_text(spec, pkg))
        .alias("type"),
        F.when(
            is_type,
            F.when(spec.rlike(r"^struct\s*\{"), "StructType")
            .when(spec.rlike(r"^interface\s*\{"), "InterfaceType")
            .otherwise("Other"),
        ).alias("type_kind"),
        location(F.col("path"), place, F.when(is_type, 6).otherwise(1)).alias("location"),
    )

    one_line = F.regexp_extract("head", r"\{(.*)\}\s*$", 1)
    inline = F.transform(
        F.split(one_line, ";"),
        lambda t: F.struct(trim(t).alias("text"), F.col("line").alias("line"), F.position(trim(t), F.col("head")).alias("col")),
    )

    def body_line(s: Column, i: Column) -> Column:
        text = trim(F.regexp_replace(F.regexp_replace(s, r"\s*//.*$", ""), r"\s*`[^`]*`$", ""))
        # One tab deep only: the lines of a nested literal type are not members.
        own = s.rlike(r"^(\t| +)[^\t ]") & ~text.rlike(r"^\}")
        return F.struct(
            F.when(own, text).otherwise("").alias("text"),
            (F.col("line") + 1 + i).alias("line"),
            F.lit(2).alias("col"),
        )

    def member(m: Column) -> Column:
        required = m["text"].rlike(_REQUIREMENT)
        embedded = m["text"].rlike(_EMBEDDED)
        other = (F.col("type_kind") == "InterfaceType") & (m["text"] != "") & ~required & ~embedded
        return F.when(
            required | embedded | other,
            F.struct(
                F.when(required, F.regexp_extract(m["text"], _REQUIREMENT, 1)).when(other, m["text"]).alias("name"),
                F.when(other, F.lit(_OTHER)).when(
                    required,
                    signature(
                        F.regexp_extract(m["text"], _REQUIREMENT, 2),
                        F.regexp_extract(m["text"], _REQUIREMENT, 3),
                        pkg,
                        params_only,
                    ),
                ).alias("type"),
                F.when(embedded, type_text(m["text"], pkg)).alias("embedded"),
                location(F.col("path"), m["line"], m["col"]).alias("location"),
            ),
        )

    raw = F.when(F.col("body").isNull(), inline).otherwise(F.transform("body", body_line))
    members = F.when(
        F.col("type_kind").isin("StructType", "InterfaceType"), F.array_compact(F.transform(raw, member))
    )
    return found.withColumn("members", members).drop("body")


def unsupported(declared: DataFrame) -> DataFrame:
    """Declarations, and members of contracts, outside the covered subset: (path, line, head, member)."""
    none = F.lit(None).cast("string")
    whole = declared.where(F.col("kind").isNull()).select("path", "line", "head", none.alias("member"))
    member = F.explode(F.filter("members", lambda m: m["type"] == _OTHER)).alias("m")
    return whole.unionByName(declared.select("path", "line", "head", member).select("path", "line", "head", F.col("m.name").alias("member")))


def declaration_rules() -> RuleSet:
    """Methods, functions, types, contracts and embeddings out of declaration rows, one rule per table."""
    name, kind, place, form = (F.col(c) for c in ("name", "type", "location", "type_kind"))
    bound, struct, contract = truthy(F.col("receiver"), "string"), form == "StructType", form == "InterfaceType"

    def each(table: TableDef, which: Column, wanted, *values) -> Event:
        """A row of ``table`` for each wanted member of the types that ``which`` holds for."""
        row = lambda m: Store(table, *[v(m) if callable(v) else v for v in values])
        return Event("TypeSpec", ForAll(F.col("members"), lambda m: Case()(which & wanted(m), row(m))))

    def inner(m: Column) -> Column:
        return m["embedded"].isNotNull()

    return RuleSet(
        Event("FuncDecl", Case()(bound, Store(METHODS, name, kind, basetype(F.col("receiver")), place))),
        Event("FuncDecl", Case()(~bound, Store(FUNCTIONS, name, kind, place))),
        Event("TypeSpec", Store(TYPES, name, place)),
        Event("TypeSpec", Case()(struct, Store(STRUCTS, name, place))),
        Event("TypeSpec", Case()(contract, Store(INTERFACES, name, place))),
        each(INTERFACE_REQS, contract, lambda m: ~inner(m), name, lambda m: m["name"], lambda m: m["type"], lambda m: m["location"]),
        each(INTERFACE_INHERITS, contract, inner, name, lambda m: basetype(m["embedded"])),
        each(STRUCT_INHERITS, struct, inner, name, lambda m: basetype(m["embedded"])),
        kind=F.col("kind"),
    )
