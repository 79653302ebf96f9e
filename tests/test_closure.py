import random

import pytest

from canopy.operators import closure as walks
from canopy.operators.closure import ancestor, closure, node_depth, subtree
from canopy.session import write_observed


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reach(pairs, root):
    seen, todo = {root: 0}, [root]
    for n in todo:
        for a, b in pairs:
            if a == n and b not in seen:
                seen[b] = seen[n] + 1
                todo.append(b)
    return seen


def test_cycle_and_self_loop_end(spark, rows):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 4)]
    got = rows(closure(edges(spark, pairs)))
    assert got == sorted((r, n, d) for r in (1, 2, 3, 4) for n, d in reach(pairs, r).items())


def test_without_reflexive_rows(spark, rows):
    got = closure(edges(spark, [(1, 2), (2, 3), (3, 1), (4, 5)]), reflexive=False)
    assert rows(got, "root", "node") == sorted([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(4, 5)])


def test_diamond_is_kept_once_with_least_depth(spark, rows):
    got = rows(closure(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (1, 4)]), spark.createDataFrame([(1,)], "n long")))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph_with_hubs(spark, rows, seed):
    rnd = random.Random(seed)
    pairs = list({(rnd.choice([0, rnd.randrange(30)]), rnd.choice([1, rnd.randrange(30)])) for _ in range(90)})
    want = sorted((r, n, d) for r in {a for a, _ in pairs} for n, d in reach(pairs, r).items())
    assert sorted(rows(closure(edges(spark, pairs), heavy_rows=5))) == want  # salted paths included


def test_known_pairs_of_roots_at_rest_are_not_looked_at(spark, rows, monkeypatch):
    """One chain goes on long after all others have ended: their pairs leave the later rounds."""
    pairs = [(i, i + 1) for i in range(5)] + [(5, 2)] + [(100 + i, 200 + i) for i in range(50)]
    want = sorted((r, n, d) for r in {a for a, _ in pairs} for n, d in reach(pairs, r).items())
    for few in (0, walks._FEW):
        monkeypatch.setattr(walks, "_FEW", few)
        plans = []
        monkeypatch.setattr(walks, "write_observed", lambda df, *a, keep=write_observed, **m: plans.append(df) or keep(df, *a, **m))
        assert sorted(rows(closure(edges(spark, pairs)))) == want
        assert any("LeftSemi" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans) == bool(few)


def test_long_chain_takes_several_steps_at_once(spark, rows):
    pairs = [(i, i + 1) for i in range(30)] + [(30, 7), (3, 40), (40, 41), (41, 20)]
    got = rows(closure(edges(spark, pairs), spark.createDataFrame([(0,), (5,), (99,)], "n long")))
    assert sorted(got) == sorted((r, n, d) for r in (0, 5, 99) for n, d in reach(pairs, r).items())
    plain = closure(edges(spark, pairs), spark.createDataFrame([(0,)], "n long"), reflexive=False)
    assert sorted(rows(plain)) == sorted((0, n, d) for n, d in reach(pairs, 0).items() if d)


def test_layers_take_no_more_than_pairs_times_edges(spark):
    layers, width = 6, 12
    dense = [(a * width + i, (a + 1) * width + j) for a in range(layers - 1) for i in range(width) for j in range(width)]
    got = closure(edges(spark, dense), spark.createDataFrame([(i,) for i in range(width)], "n long"))
    assert got.count() == width + width * width * (layers - 1)


def test_nothing_to_do(spark):
    assert closure(edges(spark, [])).count() == 0
    assert closure(edges(spark, []), reflexive=False).count() == 0


def test_closure_of_closure_is_the_closure(spark, rows):
    once = closure(edges(spark, [(1, 2), (2, 3), (3, 4), (4, 2)])).select("root", "node")
    twice = closure(once.toDF("src", "dst")).select("root", "node")
    assert [r for r in rows(twice)] == [r for r in rows(once)]


def forest(spark):
    """A chain of 20 nodes below 0, a star of 50 below 100, a lone root 999."""
    links = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(50)] + [(1, None)]
    nodes = list(range(21)) + [100] + [200 + i for i in range(50)] + [999]
    return (
        spark.createDataFrame([(n,) for n in nodes], "id long"),
        spark.createDataFrame(links, "id long, link_id long"),
    )


def test_node_depth(spark, rows):
    nodes, links = forest(spark)
    want = sorted([(i, 0, i) for i in range(21)] + [(100, 100, 0)] + [(200 + i, 100, 1) for i in range(50)] + [(999, 999, 0)])
    assert sorted(rows(node_depth(nodes, links))) == want
    assert sorted(rows(node_depth(nodes, links, heavy_rows=10))) == want


def test_node_depth_refuses_a_cycle(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(RuntimeError):
        node_depth(nodes, spark.createDataFrame([(1, 2), (2, 1)], "id long, link_id long"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 19, 25, 40])
def test_ancestor_is_clamped_at_the_root(spark, rows, n):
    nodes, links = forest(spark)
    got = dict(rows(ancestor(nodes, links, n)))
    assert all(got[i] == max(i - n, 0) for i in range(21))
    assert got[200] == (200 if n == 0 else 100) and got[999] == 999


def test_subtree_only_visits_the_wanted_root(spark, rows):
    _, links = forest(spark)
    got = rows(subtree(links, spark.createDataFrame([(18,)], "id long")))
    assert got == [(18, 18, 0), (18, 19, 1), (18, 20, 2)]
