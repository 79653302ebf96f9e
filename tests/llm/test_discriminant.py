import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import discriminant
from canopy.llm.common import fold


def sums_of(x, y):
    parts = [x[y == c] for c in (0, 1)]
    return discriminant.Sums(np.array([float(len(p)) for p in parts]), np.stack([p.sum(0) for p in parts]), np.stack([p.T @ p for p in parts]))


def test_scores_are_normal_densities():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.standard_normal((400, 3)) @ rng.standard_normal((3, 3)) + y[:, None] * [1, 0, 2]
    model = discriminant.build(sums_of(x, y), together=0.3, round_=0.1)
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    common = sum(o * (y == c).mean() for c, o in enumerate(own))
    logs = []
    for c in (0, 1):
        mixed = 0.7 * own[c] + 0.3 * common
        cov = 0.9 * mixed + 0.1 * np.trace(mixed) / 3 * np.eye(3)
        away = z - z[y == c].mean(0)
        far = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        logs.append(np.log((y == c).mean()) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * far)
    assert np.abs(model.difference(x) - (logs[1] - logs[0])).max() < 1e-9
    assert np.abs(model.score(x) - 1 / (1 + np.exp(logs[0] - logs[1]))).max() < 1e-9


def test_statistics_that_do_not_vary_and_classes_without_rows():
    x = np.array([[1.0, 5], [2, 5], [3, 5], [9, 5]])
    model = discriminant.build(sums_of(x, np.array([1, 1, 1, 0])), 0.5, 0.1)
    assert np.isfinite(model.score(np.array([[2.0, 5], [100, 7]]))).all()
    assert discriminant.build(sums_of(x, np.ones(4, int)), 0.5, 0.1) is None


def corpus(n=300):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        some = [rng.choice(vocabulary) for _ in range(rng.randint(25, 300))]
        text = ". ".join(" ".join(some[j : j + 12]).capitalize() for j in range(0, len(some), 12)) + "."
        bad = i % 6 == 0
        if bad:
            text = [" ".join(w + "$$$" for w in some), "!! ".join(some).upper(), " ".join(w for w in some[:9] for _ in range(20)), " | ".join(some)][i // 6 % 4]
        rows.append((i, text, "en", "a"))
        labels.append((i, int(not bad), 0))
    return rows, labels


@pytest.fixture
def labelled(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_labels_are_found(documents, labelled):
    rows, labels = corpus()
    got = discriminant.classify(documents(rows), labelled(labels)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and len(held) > 40
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    good, bad = ([r.score for r in held if truth[r.doc_id] == c] for c in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_and_other_columns_are_not_read(documents, labelled):
    rows, labels = corpus(120)
    docs = documents(rows)
    turned = labelled(labels).withColumn("quality", F.when(fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("zz")).withColumn("n_chars", F.lit(7))
    first = {r.doc_id: r.score for r in discriminant.classify(docs, labelled(labels)).collect()}
    second = {r.doc_id: r.score for r in discriminant.classify(other, turned).collect()}
    assert all(abs(first[i] - second[i]) < 1e-9 for i in first)


def test_odd_rows_and_odd_labels(documents, labelled, odd_rows):
    rows, labels = corpus(120)
    odd = [(1000 + i if i is not None else None, *rest) for i, *rest in odd_rows]
    more = [(1001, None, 0), (None, 1, 0), (1002, 7, 0), (3, 1, 0), (3, 0, 0), (4, 1, 0), (4, 1, 1), (99999, 1, 0)]
    got = discriminant.classify(documents(rows + odd), labelled(labels + more)).collect()
    assert len(got) == 120 + len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 1001]
    assert len(same) == 2 and same[0] == same[1]
    empty = {r.score for r in got if r.doc_id in (1002, 1003, 1004)}
    assert len(empty) == 1
    assert discriminant.classify(documents(rows).limit(0), labelled(labels)).collect() == []


def test_without_labels_of_both_kinds_the_score_is_their_share(documents, labelled):
    rows, labels = corpus(30)
    none = discriminant.classify(documents(rows), labelled(labels).limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    only = discriminant.classify(documents(rows), labelled([(i, 1, 0) for i, *_ in labels])).collect()
    assert {r.score for r in only} == {1.0}
