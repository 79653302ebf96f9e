import re

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import quality

NAMES = [p.split()[0] for p in quality.MEASURES.split(", ")]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")) if words else 0, dups, len(covered)


def test_measures_equal_the_definition(odd_rows):
    more = ["a b c d e f g h " * 3, "x\nx\n\nx \n x\nx", "# ** $% &|<>", "é ü ß y", "a " * 7, "a " * 8, "a " * 9, "b c " * 40 + "d e f " * 30]
    for text in [t for _, t, _, _ in odd_rows] + more:
        got = quality.measure(text.encode() if text is not None else None)
        assert got[:5] == brute(text)


def test_estimation_finds_accuracies_without_labels():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    votes = np.where(rng.random((20_000, 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found = quality.estimate(patterns, counts.astype(float))
    p = found.posterior(patterns)[at.ravel()]
    assert abs(found.prior - 0.7) < 0.05
    assert ((p > 0.5) == good).mean() > 0.95
    keep_right = found.rates[:, 1, 2] / (found.rates[:, 1, 0] + found.rates[:, 1, 2])
    assert np.abs(keep_right - right).max() < 0.06


def test_kept_documents(spark, documents, odd_rows):
    clean = [(100 + i, f"This sentence number {i} is plain prose about many things. " * 1 + " ".join(f"w{j}x{i}" for j in range(40)) + ".", "en", "a") for i in range(30)]
    junk = [(200 + i, "BUY!! NOW!! ### $$$ " * 30, "en", "a") for i in range(5)] + [(300, "go go go go " * 30, "en", "a")]
    got = {r.doc_id: r for r in quality.quality(documents(clean + junk + odd_rows)).collect() if r.doc_id}
    assert all(got[i].kept for i, *_ in clean)
    assert not any(got[i].kept for i, *_ in junk)
    assert got[2].base_failed and not got[2].kept and got[2].n_words == 0
    assert quality.quality(documents(odd_rows)).count() == len(odd_rows)
    assert quality.quality(documents(odd_rows).limit(0)).count() == 0


def fault_table(rng, n):
    """Votes of five rules; rules 0 and 1 look for one fault, 2 and 3 for another, each a share of the bad documents."""
    kind = rng.choice(3, n, p=[0.86, 0.06, 0.08])
    chance = np.full((n, 5), 0.01)
    chance[kind == 1, :2] = 0.95
    chance[kind == 2, 2:4] = 0.9
    return np.where(rng.random((n, 5)) < chance, -1, 1), kind


def plain_em(votes, start, kinds, rounds=1000):
    """The same model document by document, with loops, from chances of each class to start with."""
    n, rules = votes.shape
    weight = quality.BELIEF * np.array([quality.GOOD, *[(1 - quality.GOOD) / len(kinds)] * len(kinds)])
    chance = start
    for _ in range(rounds):
        rates = np.zeros((rules, 1 + len(kinds), 3))
        for r in range(rules):
            for c in range(1 + len(kinds)):
                believed = quality.ON_GOOD if c == 0 else quality.ON_ITS_FAULT if r in kinds[c - 1] else quality.ON_OTHERS
                seen = [chance[votes[:, r] == v, c].sum() / n + weight[c] * b for v, b in zip((-1, 0, 1), believed)]
                rates[r, c] = np.array(seen) / sum(seen)
        shares = (chance.mean(0) + weight) / (1 + weight.sum())
        joint = np.array([[shares[c] * np.prod([rates[r, c, v + 1] for r, v in enumerate(row)]) for c in range(len(shares))] for row in votes])
        chance = joint / joint.sum(1, keepdims=True)
    return chance[:, 0]


def test_estimate_equals_a_plain_em():
    rng = np.random.default_rng(3)
    votes, _ = fault_table(rng, 60)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    faults = ["a", "a", "b", "b", "c"]
    found = quality.estimate(patterns, counts.astype(float), faults)
    kinds = [[0, 1], [2, 3], [4]]
    assert len(found.shares) == 4
    start = np.full((60, 4), 0.0)
    for i, row in enumerate(votes):
        accused = [float(any(row[r] == -1 for r in k)) for k in kinds]
        good = 0.3 if any(accused) else 0.98
        start[i] = [good, *[(1 - good) * (a / sum(accused) if any(accused) else 1 / 3) for a in accused]]
    assert np.abs(plain_em(votes, start, kinds) - found.posterior(patterns)[at.ravel()]).max() < 1e-3


@pytest.mark.parametrize("n", [150, 1_500, 15_000, 150_000])
def test_a_fault_seen_by_dependent_rules_is_dropped_at_every_size(n):
    votes, kind = fault_table(np.random.default_rng(n), n)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality.estimate(patterns, counts.astype(float), ["a", "a", "b", "b", "c"]).posterior(patterns)[at.ravel()]
    both = ((votes[:, 0] == -1) & (votes[:, 1] == -1)) | ((votes[:, 2] == -1) & (votes[:, 3] == -1))
    assert (p[both] < 0.5).all()
    assert (p[(votes == 1).all(1)] > 0.9).all()
    assert ((p > 0.5) == (kind == 0)).mean() > 0.97


def test_copies_of_a_table_change_no_verdict():
    votes, _ = fault_table(np.random.default_rng(8), 500)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    one, many = (quality.estimate(patterns, counts * float(k), ["a", "a", "b", "b", "c"]).posterior(patterns) for k in (1, 1_000_000))
    assert np.abs(one - many).max() < 1e-6


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_verdicts_agree_with_the_labels_at_every_size(spark, size):
    """The labels judge the result; the method never sees them."""
    folder = f"/root/testdata/{size}"
    if not os.path.isdir(folder):
        pytest.skip("provided tables not found")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = quality.quality(docs).join(labels.select("doc_id", "quality"), "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("count")).collect()}
    bad, good = (n.get((q, False), 0) + n.get((q, True), 0) for q in (0, 1))
    assert n.get((0, False), 0) >= 0.98 * bad and n.get((1, True), 0) >= 0.99 * good and bad and good
