import numpy as np

from canopy.llm import embeddings
from canopy.llm.components import Forest


def brute(rows, threshold=0.9):
    good = [
        (k, i, np.array(v, float)) for k, (i, v) in enumerate(rows)
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links, forest = [0] * len(rows), Forest()
    for a, i, x in good:
        forest.find(i)
        for b, j, y in good:
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                forest.union(i, j)
    return links, forest


def check(spark, rows, threshold=0.9):
    links, forest = brute(rows, threshold)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS v", "3 AS size")
    got = embeddings.near_vectors(df, threshold=threshold, window=16).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in got) == sorted((str(i), n) for (i, _), n in zip(rows, links))
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == forest.find(r.vec_id)
            assert r.kept == (r.component_id == r.vec_id)


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(16) for _ in range(120)]
    for size in (2, 5, 60):
        centre = rng.standard_normal(16)
        x += [centre + 0.05 * rng.standard_normal(16) for _ in range(size)]
    x += [x[0] * 3] * 20
    return [(i, np.float32(v).tolist()) for i, v in enumerate(x)]


def test_equals_brute_force(spark):
    check(spark, vectors())


def test_large_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "TASK_ROWS", 300)
    check(spark, vectors(2))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, []), (9, [1.0]), (None, [1.0, 0.0]), (None, None), (10, [-1.0, 0.0]), (11, [1e-38, 0.0]), (12, [3e38, 1.0]), (13, [1.0, -0.0]),
    ]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(empty).count() == 0


def test_found_pairs_are_united_across_passes(spark):
    """Recall of the windows alone, measured on pairs at the threshold."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * i, np.float32(x).tolist()), (2 * i + 1, np.float32(0.91 * x + np.sqrt(1 - 0.91**2) * y).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_vectors(df, window=8).collect()
    assert sum(r.n_links > 0 for r in got) >= 0.9 * len(rows)


def test_a_key_with_several_vectors_has_the_links_of_all(spark):
    rng = np.random.default_rng(4)
    a, b, c = (rng.standard_normal(16) for _ in range(3))
    near = lambda v: (v + 0.02 * rng.standard_normal(16)).tolist()
    rows = [(3, a.tolist()), (3, b.tolist()), (9, near(b)), (4, c.tolist()), (5, c.tolist()), (5, near(a)), (8, None), (8, [0.0] * 16)]
    check(spark, [(i, None if v is None else np.float32(v).tolist()) for i, v in rows])
