import random
from collections import defaultdict

import numpy as np
import pytest

from canopy.llm import minhash
from canopy.llm.components import Forest, components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets, forest = [(i, shingle_set(t)) for i, t in rows if i is not None], Forest()
    for i, _ in sets:
        forest.find(i)
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                forest.union(i, j)
    return forest


def check(spark, documents, rows):
    forest = brute([(i, t) for i, t, *_ in rows])
    got = minhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(len(shingle_set(t)))
    for r in got:
        assert r.n_shingles in texts[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == forest.find(r.doc_id), r
            assert r.kept == (r.doc_id == r.component_id)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_equals_brute_force(spark, documents):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text(rng.randint(1, 80)), "en", "a") for i in range(60)]
    copies = near_copies(rng, text(200), 40, 2) + near_copies(rng, text(200), 40, 5) + [text(150)] * 30
    # A chain: neighbours are near, ends are not.
    chain = text(100).split()
    for k in range(25):
        chain[k * 3] = f"c{k}"
        copies.append(" ".join(chain))
    copies += ["Same Words HERE", "same words here", "same words", "Ä b c d e f", "ä b c d e f"]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(copies)]
    rng.shuffle(rows)
    check(spark, documents, rows)


def test_odd_rows(spark, documents, odd_rows):
    check(spark, documents, odd_rows)
    assert minhash.near_duplicates(documents(odd_rows).limit(0)).count() == 0


def test_one_group_of_half_of_all_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 2_000)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(2)
    base = " ".join(f"b{i}" for i in range(120))
    rows = [(i, t, "en", "a") for i, t in enumerate(near_copies(rng, base, 150, 3))]
    rows += [(500 + i, f"other text number {i} " + " ".join(f"z{rng.randrange(999)}" for _ in range(30)), "en", "a") for i in range(50)]
    check(spark, documents, rows)


def test_sketches_fill_every_bin_and_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 50, 3000):
        sketch = minhash.sketches([rng.integers(0, 1 << 63, n).astype(np.uint64)])
        assert (sketch != minhash._EMPTY).all()
    for similarity in (0.3, 0.6, 0.85, 0.95):
        errors = []
        for _ in range(40):
            both = int(1000 * similarity)
            x = rng.integers(0, 1 << 63, 2000 - both).astype(np.uint64)
            a, b = minhash.sketches([x[:1000], np.concatenate([x[:both], x[1000:]])])
            errors.append((a == b).mean() - both / (2000 - both))
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 9), (2, 7), (7, 2)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 400)]])
def test_components(spark, edges):
    forest = Forest()
    for a, b in edges:
        forest.union(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted((r.id, r.component_id) for r in got) == sorted((x, forest.find(x)) for x in {v for e in edges for v in e if e[0] != e[1]})


def pairs_between(rng, n):
    """Pairs whose sets have a similarity of 90 / 110: each of two changed words is in five of 100 shingles."""
    rows = []
    for i in range(n):
        words = [f"p{i}x{rng.randrange(10**6)}" for _ in range(104)]
        rows.append((2 * i, " ".join(words), "en", "a"))
        words[30], words[70] = "new", "other"
        rows.append((2 * i + 1, " ".join(words), "en", "a"))
    return rows


def test_pairs_between_80_and_85_percent(spark, documents):
    rows = pairs_between(random.Random(5), 150)
    forest = brute([(i, t) for i, t, *_ in rows], 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows), percent=80).collect()}
    assert got == {i: forest.find(i) for i, *_ in rows} == {i: i // 2 * 2 for i, *_ in rows}
    assert all(r.kept for r in minhash.near_duplicates(documents(rows)).collect())


def test_bands_and_sketch_test_follow_the_threshold():
    assert minhash.bands_for(85) == 25 and minhash.BINS == 125
    for percent in (70, 80, 85, 95):
        bands, share = minhash.bands_for(percent), percent / 100
        assert (1 - share**minhash.ROWS) ** bands <= minhash.MISS
        bins = bands * minhash.ROWS
        assert (bins * share - minhash.least_agreeing(percent, bins)) / (bins * share * (1 - share)) ** 0.5 > 6


def test_an_id_with_several_texts_has_the_links_of_all(spark, documents):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(4))
    near_b, near_d = near_copies(rng, b, 1, 1)[0], near_copies(rng, d, 1, 1)[0]
    rows = [(3, a), (3, b), (9, near_b), (4, c), (5, c), (5, d), (6, near_d), (7, a + " x"), (8, d)]
    check(spark, documents, [(i, t, "en", "s") for i, t in rows])
    check(spark, documents, [(i, t, "en", "s") for i, t in [(3, a), (3, b), (4, c)]])
