import random

import pytest

from canopy.operators import tour as t

LINKS = "id string, label string, link_number long, link_id string"


def forest(rng, n, roots):
    """Parents of n nodes with shuffled names; nodes without children and single chains included."""
    names = [f"n{i}" for i in rng.sample(range(1000), n)]
    parent = {names[i]: names[rng.randrange(max(0, i - 4), i)] if i % 3 else names[rng.randrange(i)] for i in range(roots, n)}
    links, counts = [], {}
    for child, p in parent.items():
        k = counts[p] = counts.get(p, 0) + 1
        links.append((p, "only", None, child) if k == 1 and rng.random() < 0.3 else (p, "kids", 10 * k, child))
    return names, links


def plain(names, links):
    kids, has_parent = {}, {c for *_, c in links}
    for p, label, number, child in sorted(links, key=lambda x: (x[2] is not None, x[2] or 0, x[1])):
        kids.setdefault(p, []).append(child)
    out = []
    for root in names:
        if root in has_parent:
            continue
        pre = post = 0
        stack = [(root, 0, None)]
        open_ = {}
        while stack:
            node, depth, closing = stack.pop()
            if closing:
                post += 1
                out.append((root, node, open_[node], post, depth, pre - open_[node] + 1))
                continue
            pre += 1
            open_[node] = pre
            stack.append((node, depth, True))
            stack += [(c, depth + 1, None) for c in reversed(kids.get(node, []))]
    return sorted(out)


@pytest.fixture
def make(spark):
    return lambda names, links: (spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(links, LINKS))


@pytest.mark.parametrize("seed,n,roots", [(1, 60, 4), (2, 25, 1)])
def test_numbers_ranges_and_ancestors(make, spark, seed, n, roots):
    names, links = forest(random.Random(seed), n, roots)
    numbers = t.tour(*make(names, links))
    want = plain(names, links)
    assert sorted(map(tuple, numbers.select("root", "id", "pre", "post", "depth", "size").collect())) == want
    spans = {v: (r, pre, pre + size - 1) for r, v, pre, _, _, size in want}
    tops = names[::3]
    inside = sorted((top, v) for top in tops for r, v, pre, *_ in want if r == spans[top][0] and spans[top][1] <= pre <= spans[top][2])
    found = t.below(numbers, spark.createDataFrame([(x,) for x in [*tops, tops[0], None, "nobody"]], "id string"), block=4)
    assert sorted(map(tuple, found.select("top", "id").collect())) == inside
    above = t.ancestors(numbers, spark.createDataFrame([(x,) for x in names], "id string"), block=4)
    assert sorted((r.top, r.id) for r in above.collect() if r.top in tops) == inside
    ordered = t.in_visit_order(numbers).orderBy("line_number").collect()
    assert [(r.root, r.pre) for r in ordered] == sorted((r, pre) for r, _, pre, *_ in want)
    assert [r.line_number for r in ordered] == list(range(1, n + 1))


def test_a_crowded_parent_and_a_long_chain(make):
    names = ["top", *[f"k{i}" for i in range(300)], *[f"d{i}" for i in range(120)]]
    links = [("top", "kids", i + 1, f"k{i}") for i in range(300)] + [("k7", "kids", 1, "d0")] + [(f"d{i}", "next", None, f"d{i + 1}") for i in range(119)]
    nodes, rows = make(names, links)
    assert sorted(map(tuple, t.tour(nodes, rows, heavy_rows=50).collect())) == plain(names, links)


def test_lone_nodes_and_what_is_no_forest(make):
    nodes, none = make(["a", "b"], [("a", "x", None, None)])
    assert sorted(map(tuple, t.tour(nodes, none).collect())) == [("a", "a", 1, 1, 0, 1), ("b", "b", 1, 1, 0, 1)]
    assert t.tour(nodes.limit(0), none).collect() == []
    with pytest.raises(ValueError, match="more than one parent"):
        t.tour(*make(["a", "b", "c"], [("a", "x", 1, "c"), ("b", "x", 1, "c")]))
    with pytest.raises(RuntimeError, match="cycle"):
        t.tour(*make(["r", "a", "b", "c"], [("r", "x", 1, "c"), ("a", "x", 1, "b"), ("b", "x", 1, "a")]))


def test_trees_of_few_levels_are_numbered_without_following_the_tour(make, rows, monkeypatch):
    written = []
    monkeypatch.setattr(t, "materialize", lambda df, name="table", keep=t.materialize: written.append(name) or keep(df, name))
    names = [f"n{i}" for i in range(41)]
    links = [(f"n{i // 3}", "kids", i, f"n{i}") for i in range(3, 40)] + [("n2", "only", None, "n40")]
    want = plain(names, links)
    assert rows(t.tour(*make(names, links))) == sorted(want, key=lambda x: tuple((True, str(v)) for v in x))
    assert "tour" not in written
