import re
from fractions import Fraction

from canopy.llm import mixing


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        level = Fraction(rest, sum(weight[s] for s in free)) if free else 0
        more = {s for s in free if cap * sizes[s] < weight[s] * level}
        if not more:
            return {s: Fraction(cap * sizes[s]) if s in full else weight[s] * level for s in names}
        full |= more


def test_targets_follow_the_resharing(spark, documents):
    rows = [(i, "w " * n, "en", s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (90, "c"), (5, None), (40, "Z"), (0, "e"), (7, "é")])]
    got = {r.doc_id: r for r in mixing.mix_plan(documents(rows)).collect()}
    want = expected_targets({s: len(t.split()) for _, t, _, s in rows})
    for i, text, _, source in rows:
        assert abs(got[i].target - float(want[source])) < 1e-9
        assert got[i].size == got[i].source_size == len(text.split())
        assert got[i].taken == got[i].copies * got[i].size <= 3 * got[i].size
        rate = float(want[source]) / got[i].size if got[i].size else 0
        assert got[i].copies in (int(rate), int(rate) + 1) or not got[i].size


def test_words_taken_come_near_the_target_and_reruns_agree(spark, documents):
    rows = [(i, "w " * (1 + i % 9), "en", "abcdef"[i % 6] if i % 3 else "hot") for i in range(6000)]
    docs = documents(rows)
    first = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    by_source = {}
    for r in first:
        taken, target = by_source.get(r.source_size, (0, r.target))
        by_source[r.source_size] = (taken + r.taken, target)
    assert all(abs(taken - target) < 0.1 * target for taken, target in by_source.values())
    emitted = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in emitted} == {r.doc_id: r.copies for r in first if r.copies}


def test_odd_rows_and_empty_table(spark, documents, odd_rows):
    docs = documents(odd_rows)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(odd_rows)
    assert sorted(r.size for r in plan) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in odd_rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    words_missing = documents([(1, None, "en", "a"), (2, "", "en", None)])
    assert [r.taken for r in mixing.mix_plan(words_missing).collect()] == [0, 0]
