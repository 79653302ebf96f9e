import random

import pytest

from canopy.operators import reach as r

EDGES = "src long, dst long"


def plain(edges, roots=None, reflexive=True):
    """Breadth first from every root."""
    after = {}
    for s, d in edges:
        if s is not None and d is not None:
            after.setdefault(s, set()).add(d)
    out = set()
    for root in after if roots is None else roots:
        seen, todo = set(), [root]
        while todo:
            for d in after.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        out |= {(root, d) for d in seen | ({root} if reflexive else set())}
    return sorted(out)


def plain_components(edges):
    pairs = set(plain(edges))
    ids = {v for e in edges for v in e if None not in e}
    return sorted((v, min([v, *(u for u in ids if (u, v) in pairs and (v, u) in pairs)])) for v in ids)


def graph(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed,nodes,edges", [(1, 30, 25), (2, 30, 45), (3, 12, 60)])
def test_random_graphs(spark, seed, nodes, edges):
    some = graph(random.Random(seed), nodes, edges) + [(None, 1), (2, None), (3, 3)]
    df = spark.createDataFrame(some, EDGES)
    assert sorted(map(tuple, r.strong_components(df).collect())) == plain_components(some)
    assert sorted(map(tuple, r.reach(df).collect())) == plain(some)
    roots = [0, 3, 5, 77]
    got = r.reach(df, spark.createDataFrame([(x,) for x in [*roots, 3, None]], "id long"), reflexive=False)
    assert sorted(map(tuple, got.collect())) == plain(some, roots, reflexive=False)


def test_rings_are_one_component_each_and_the_way_between_them_is_none(spark):
    ring = [(i, (i + 1) % 50) for i in range(50)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    way = [(49, 200), *[(200 + i, 201 + i) for i in range(20)], (220, 100), (106, 300), (300, 301)]
    got = dict(map(tuple, r.strong_components(spark.createDataFrame(ring + way, EDGES)).collect()))
    assert got == {i: 0 for i in range(50)} | {i: 100 for i in range(100, 107)} | {i: i for i in [*range(200, 221), 300, 301]}


def test_a_chain_of_ten_thousand_edges_takes_rounds_by_its_logarithm(spark, monkeypatch):
    tables = []
    keep = r.materialize
    monkeypatch.setattr(r, "materialize", lambda df, name="table": tables.append(name) or keep(df, name))
    edges = spark.range(10_000).selectExpr("id * 7919 % 10007 AS src", "(id + 1) * 7919 % 10007 AS dst")
    found = r.reach(edges, spark.createDataFrame([(0,)], "id long"))
    assert found.count() == 10_001 and found.select("node").distinct().count() == 10_001
    assert tables.count("reach") <= 16 and tables.count("jumps") <= 30


def test_hubs_end_the_doubling_not_the_walk(spark, monkeypatch):
    monkeypatch.setattr(r, "GROWTH", 1)
    star = [(i, 1000) for i in range(40)] + [(1000, 2000 + i) for i in range(40)] + [(2000 + i, 2001 + i) for i in range(60)] + [(2060, 1000)]
    df = spark.createDataFrame(star, EDGES)
    jumps = r.Jumps(df, len(star))
    assert not jumps.grow() and jumps.full and not jumps.ended
    assert sorted(map(tuple, r.reach(df).collect())) == plain(star)
    assert sorted(map(tuple, r.strong_components(df).collect())) == plain_components(star)


def test_heavy_nodes_and_empty_graphs(spark):
    some = [(1, i) for i in range(2, 40)] + [(i, 50) for i in range(2, 40)] + [(50, 51), (51, 1)]
    df = spark.createDataFrame(some, EDGES)
    assert sorted(map(tuple, r.reach(df, heavy_rows=5).collect())) == plain(some)
    none = df.limit(0)
    assert r.strong_components(none).collect() == [] and r.reach(none).collect() == []
    assert [tuple(x) for x in r.reach(none, spark.createDataFrame([(4,)], "id long")).collect()] == [(4, 4)]


def test_chains_need_no_labels_and_rings_are_told_at_once(spark, monkeypatch):
    chains = [(10 * c + i, 10 * c + i + 1) for c in range(6) for i in range(7)]
    monkeypatch.setattr(r, "_labels", lambda *_: pytest.fail("labels of a graph without cycles"))
    df = spark.createDataFrame(chains, EDGES)
    assert sorted(map(tuple, r.strong_components(df).collect())) == plain_components(chains)
    some = spark.createDataFrame([(0,), (13,), (99,)], "id long")
    assert sorted(map(tuple, r.reach(df, some).collect())) == plain(chains, [0, 13, 99])
    looped = spark.createDataFrame([*chains, (13, 13)], EDGES)
    assert sorted(map(tuple, r.reach(looped, some, reflexive=False).collect())) == plain([*chains, (13, 13)], [0, 13, 99], reflexive=False)
    rings = r.Jumps(spark.createDataFrame([(8 * c + i, 8 * c + (i + 1) % 8) for c in range(3) for i in range(8)], EDGES), 24)
    assert not rings.acyclic() and len(rings.levels) == 2


def test_labels_are_plain_numbers_and_rings_below_others_settle_at_once(spark, monkeypatch):
    """A tree of 63 rings, each leading to the one above it."""
    edges = [(4 * b + i, 4 * b + (i + 1) % 4) for b in range(1, 64) for i in range(4)] + [(4 * b + 1, b // 2 * 4 + 2) for b in range(2, 64)]
    written, labels = [], []
    keep, keep_rows = r.write_observed, r.materialize
    monkeypatch.setattr(r, "write_observed", lambda df, path, **m: written.append(df.schema) or keep(df, path, **m))

    def counted(df, name="table"):
        table, rows = keep_rows(df, name)
        if name == "labels":
            labels.append(rows)
        return table, rows

    monkeypatch.setattr(r, "materialize", counted)
    got = dict(map(tuple, r.strong_components(spark.createDataFrame(edges, EDGES)).collect()))
    assert got == {4 * b + i: 4 * b for b in range(1, 64) for i in range(4)}
    assert written and all(f.dataType.typeName() == "long" for schema in written for f in schema)
    assert labels[0] == 252 and sum(labels[1:]) < 252


def test_text_ids_have_components_too(spark):
    some = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("y", None)]
    got = r.strong_components(spark.createDataFrame(some, "src string, dst string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("x", "x")]
