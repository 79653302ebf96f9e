import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from canopy.llm import periodic
from canopy.llm.queries import planted_period


def brute_lyndon(x):
    out = []
    for i in range(len(x)):
        words = (x[i:j] for j in range(len(x), i, -1))
        out.append(len(next(w for w in words if all(w < w[k:] for k in range(1, len(w))))))
    return out


def brute_runs(x, least=12):
    """By definition: every period, every stretch of agreement, smallest period checked."""
    out, n = set(), len(x)
    for p in range(1, n // 2 + 1):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and x[end] == x[end + p]:
                end += 1
            whole = x[start : end + p]
            if len(whole) >= max(least, 2 * p) and all(any(a != b for a, b in zip(whole, whole[q:])) for q in range(1, p)):
                out.add((start, end + p, p))
            start = end + 1
    return sorted(out, key=lambda t: (t[0], t[2]))


def test_lyndon_lengths_by_grouping():
    rng = random.Random(1)
    for _ in range(1500):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 16))]
        ranks = [sorted(set(x)).index(v) for v in x]
        assert periodic.lyndon_lengths(ranks) == brute_lyndon(ranks)
    assert periodic.lyndon_lengths([]) == []


def test_runs_of_short_sequences():
    rng = random.Random(2)
    for _ in range(1500):
        x = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(1, 40))]
        assert sorted(periodic.runs(np.array(x), 2)) == sorted(brute_runs(x, 2))


@pytest.mark.parametrize("kind", ["thue-morse", "fibonacci", "unary"])
def test_sequences_that_mislead_hashes_or_nest_runs(kind):
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    x = {"thue-morse": [i.bit_count() % 2 for i in range(256)], "fibonacci": b[:150], "unary": [7] * 60}[kind]
    assert sorted(periodic.runs(np.array(x), 2)) == sorted(brute_runs(x, 2))


def test_hash_failures_are_replaced_by_exact_comparison(monkeypatch):
    monkeypatch.setattr(periodic, "_symbols", lambda ids: np.ones(len(ids), np.uint64))  # all symbols alike
    x = [*range(20), *[1, 2, 3] * 6, *range(5)]
    assert periodic.runs(np.array(x), 12) == brute_runs(x)


def texts(rng, n):
    for _ in range(n):
        base = [b"%d" % rng.randrange(rng.randint(2, 30)) for _ in range(rng.randint(0, 50))]
        unit = [b"u%d" % rng.randrange(15) for _ in range(rng.randint(1, 12))]
        yield base + unit * rng.choice([0, 1, 2, 3, 9]) + unit[: rng.randint(0, len(unit))] + base[: rng.randint(0, 20)]


def test_documents_worked_on_together_equal_each_alone():
    many = list(texts(random.Random(3), 400))
    for lo in range(0, 400, 20):
        for found, got in zip(many[lo : lo + 20], periodic.runs_of_documents(many[lo : lo + 20])):
            assert got == brute_runs(found)


def brute_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode() if text else b"")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, e, p in found for i in range(s + p, e)}
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_summary_of_whole_documents(spark, documents, odd_rows):
    rng = random.Random(4)
    rows = [(100 + i, rng.choice([" ", "\n", " \t"]).join(w.decode() for w in t), "en", "a") for i, t in enumerate(texts(rng, 150))]
    rows += [(i, (t or "")[:2000] if t else t, lang, source) for i, t, lang, source in odd_rows]
    df = documents(rows)
    got = sorted(map(tuple, periodic.summary(df, edit=planted_period).collect()), key=str)
    assert got == sorted([brute_row(i, t) for i, t, *_ in rows], key=str)
    assert sum(r[1] > 0 for r in got) > 50
    assert periodic.summary(df.limit(0)).count() == 0


def test_rows_of_runs_and_collapsed_text(spark, documents):
    docs = documents([(1, "a b c " + "x y z " * 5 + "x end", "en", "a"), (2, None, "en", "a"), (3, "no run here", None, None)])
    assert [tuple(r) for r in periodic.periodic_runs(docs).collect()] == [(1, 3, 16, 3)]
    assert {r.doc_id: (r.n_runs, r.collapsed) for r in periodic.collapse(docs).collect()} == {1: (1, "a b c x y z end"), 2: (0, ""), 3: (0, "no run here")}


def test_a_very_long_text_in_chunks_of_its_own(spark, documents, odd_rows):
    long = next(t for i, t, *_ in odd_rows if i == 6)
    got = {r.doc_id: r for r in periodic.summary(documents([odd_rows[0], (6, long, "en", "a"), odd_rows[2]])).collect()}
    assert (got[6].start, got[6].length, got[6].period) == (0, 90_000, 977 * 3) and got[6].n_runs == 1
