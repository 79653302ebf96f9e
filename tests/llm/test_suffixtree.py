import math
import random
import zlib
from collections import Counter

import numpy as np

from canopy.llm import suffixtree
from canopy.llm.common import fold


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def scored(docs, **more):
    return suffixtree.scored(docs, fold("doc_id") == 1, **more)


def test_base_score_equals_the_definition(spark, documents, odd_rows):
    got = scored(documents(odd_rows)).collect()
    counts = Counter(w for i, t, *_ in odd_rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in odd_rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((str(i), held(i), len(words), sum(w in counts for w in words), n, round(base, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) for r in got)


def test_empty_table_and_no_training_rows(spark, documents):
    only_held_out = next(i for i in range(100) if held(i))
    docs = documents([(only_held_out, "a b", "en", "s")])
    (row,) = scored(docs).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert scored(docs.limit(0)).count() == 0


def patterned(n=400):
    """Text in which the next word depends on the last two."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = ["w0", "w1"]
        for _ in range(60):
            k = (int(words[-1][1:]) * 3 + int(words[-2][1:])) % 20 if rng.random() < 0.8 else rng.randrange(20)
            words.append(f"w{k}")
        rows.append((i, " ".join(words), "en", "s"))
    return rows


def test_contexts_pay_on_held_out_text(spark, documents):
    got = [r for r in scored(documents(patterned()), context_share=1e-4, symbol_share=1e-5).collect() if r.held_out]
    base, score = sum(r.base_score for r in got), sum(r.score for r in got)
    assert score > 0.75 * base  # both negative
    shallow = [r for r in scored(documents(patterned()), depth=1, context_share=1e-4, symbol_share=1e-5).collect() if r.held_out]
    assert score > sum(r.score for r in shallow)


def test_independent_words_keep_no_context(spark, documents, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(100)), "en", "s") for i in range(300)]
    got = [r for r in scored(documents(rows)).collect() if r.held_out]
    assert abs(sum(r.score for r in got) / sum(r.base_score for r in got) - 1) < 0.02


def test_probabilities_of_every_state_sum_to_one(spark, documents):
    docs = documents(patterned(100))
    chunks = suffixtree.chunked(docs, fold("doc_id") == 1)
    counted, total, types = suffixtree.word_counts(chunks)
    tree = suffixtree.fit(chunks, counted, total, types, 3, 1e-3, 1e-3, 0.0, 0.0)
    assert len(tree.depths) == 3 and all(len(level["context"]) for level in tree.depths)
    rows = counted.collect()
    words = np.array([r["word"] for r in rows] + [12345], np.int64).view(np.uint64)
    root = tree.root(np.array([r["n"] for r in rows] + [0], float))
    assert abs(root.sum() - 1) < 1e-9
    for depth, (level, chain) in enumerate(zip(tree.depths, tree.chains), 1):
        for context in level["context"][:20]:
            at = np.full(len(words), context)
            p = tree.shorter(at, depth, words, root)
            assert abs(p.sum() - 1) < 1e-9
            assert abs(suffixtree.in_state(level, at, words, p).sum() - 1) < 1e-6


def test_chunks_do_not_change_scores(spark, documents, monkeypatch):
    docs = documents(patterned(80))
    whole = sorted((r.doc_id, round(r.score, 6)) for r in scored(docs).collect())
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", 200)
    assert sorted((r.doc_id, round(r.score, 6)) for r in scored(docs.repartition(9)).collect()) == whole


def brute_scores(rows, depth=3, least=2):
    """score of every row by its definition, with dictionaries."""
    counts = [Counter() for _ in range(depth + 2)]
    texts = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    for (i, *_), words in zip(rows, texts):
        for k in range(1, depth + 2):
            for at in range(k, len(words) + 1) if not held(i) else ():
                counts[k][tuple(words[at - k : at])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    own, backoff = {}, {}

    def p(context, word):
        if not context:
            return (counts[1][(word,)] + 0.5) / (n + 0.5 * (v + 1))
        if context in backoff:
            return own[context].get(word) or backoff[context] * p(context[1:], word)
        return p(context[1:], word)

    for d in range(1, depth + 1):
        symbols = {}
        for gram, m in counts[d + 1].items():
            if m >= least:
                symbols.setdefault(gram[:-1], {})[gram[-1]] = m
        for context, found in symbols.items():
            total = counts[d][context]
            q = {w: (m - suffixtree.DISCOUNT) / total for w, m in found.items()}
            shorter = {w: p(context[1:], w) for w in found}
            left = max(1 - sum(q.values()), 1e-12) / max(1 - sum(shorter.values()), 1e-12)
            gain = sum(m * math.log(q[w] / shorter[w]) for w, m in found.items()) + (total - sum(found.values())) * math.log(left)
            if gain >= suffixtree.DIVERGENCE * total and gain >= suffixtree.LEAST_GAIN:
                own[context], backoff[context] = q, left
    scores = [(i, sum(math.log10(p(tuple(words[max(0, at - depth) : at]), w)) for at, w in enumerate(words))) for (i, *_), words in zip(rows, texts)]
    return scores, backoff


def test_scores_equal_the_definition(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", 500)
    rows = patterned(120) + [(1000, None, "en", "s"), (1001, "w0 w1 unseen w1 w4", "en", "s"), (1002, "w0", "en", "s")]
    want, contexts = brute_scores(rows)
    assert {len(c) for c in contexts} == {1, 2, 3}
    got = {r.doc_id: r.score for r in scored(documents(rows).repartition(3)).collect()}
    assert len(got) == len(want) and all(abs(got[i] - s) < 1e-6 * max(1, abs(s)) for i, s in want)


def test_rare_contexts_count_however_large_the_corpus_is(spark, documents):
    """Each context occurs four times among 100,000 positions and more: less than a share of 5e-5."""
    rng = random.Random(4)
    filler = lambda n: " ".join(f"f{rng.randrange(300)}" for _ in range(n))
    rows = [(i, filler(200), "en", "s") for i in range(700)]
    train = [i for i in range(1000, 3000) if not held(i)]
    out = [i for i in range(1000, 3000) if held(i)][:40]
    planted = [(next(train_ids), f"a{c} b{c} c{c} d{c}", "en", "s") for train_ids in [iter(train)] for c in range(40) for _ in range(4)]
    planted += [(i, f"a{c} b{c} c{c} d{c}", "en", "s") for c, i in enumerate(out)]
    got = {r.doc_id: r for r in scored(documents(rows + planted)).collect()}
    assert got[out[0]].train_tokens > 100_000
    # All but the first word follow from the word before, and so does the end.
    assert all(got[i].score > 0.4 * got[i].base_score for i in out)


def test_slices_do_not_change_scores(spark, documents, monkeypatch):
    docs = documents(patterned(80))
    whole = sorted((r.doc_id, round(r.score, 6)) for r in scored(docs).collect())
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(suffixtree, "SLICE_TOKENS", 500)
    assert sorted((r.doc_id, round(r.score, 6)) for r in scored(docs.repartition(5)).collect()) == whole


def test_no_table_has_a_row_for_a_gram(spark, documents, monkeypatch):
    """Rows of grams broke the limit of disk: what is written and shuffled has packed arrays, a row for a chunk."""
    rows, write = [], suffixtree.write_observed

    def watched(df, path, **metrics):
        seen = write(df, path, **metrics)
        rows.append(seen["rows"])
        return seen

    monkeypatch.setattr(suffixtree, "write_observed", watched)
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", 1000)
    docs = documents(patterned(100)).repartition(2)
    n = suffixtree.chunked(docs, fold("doc_id") == 1).count()
    assert scored(docs).count() == 100
    assert rows and max(rows) <= n


def test_counts_of_more_than_a_byte_survive_the_squeezing():
    n = np.array([0, 1, 254, 255, 256, 7, 2**40, 0])
    small, large = suffixtree._squeezed(n)
    assert len(small) == len(n) and suffixtree._counts_of(small, large, len(n)).tolist() == n.tolist()
    assert suffixtree._counts_of(None, None, 3).tolist() == [0, 0, 0]


def test_answers_join_chunks_without_moving_them(spark, documents, monkeypatch):
    """Chunks and all answers were shuffled again at every step, which broke the limit of disk."""
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", 500)
    docs = documents(patterned(80)).repartition(3)
    chunks, *_ = suffixtree.fitted(suffixtree.chunked(docs, fold("doc_id") == 1), 2, 0.0, 0.0, suffixtree.DIVERGENCE, suffixtree.LEAST_GAIN)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()


def test_one_chunk_sends_what_a_gram_contributes(spark, documents, monkeypatch):
    """Every chunk that had a gram sent its part of the sums, so common text was sent over and over."""
    sent_by, told = [], suffixtree._told

    def watched(chunks, step, sent, *more):
        if step.startswith("b_"):
            for r in sent.select("keys", "tested").collect():
                keys = np.cumsum(suffixtree._of_planes(r.keys, np.uint64), dtype=np.uint64)
                sent_by.extend((step, int(key)) for key in keys[suffixtree._bits(r.tested, len(keys))])
        return told(chunks, step, sent, *more)

    monkeypatch.setattr(suffixtree, "_told", watched)
    monkeypatch.setattr(suffixtree, "CHUNK_TOKENS", 100)
    text = patterned(1)[0][1]
    docs = documents([(i, text, "en", "s") for i in range(40)]).repartition(2)
    assert scored(docs).count() == 40
    assert {step for step, _ in sent_by} == {"b_1", "b_2", "b_3"} and len(sent_by) == len(set(sent_by))


def test_distinct_hashes_equal_those_of_numpy():
    rng = np.random.default_rng(5)
    plain = rng.integers(0, 2**64, 500, np.uint64)
    alike = np.uint64(7 << 40) + rng.integers(0, 4, 100, np.uint64)  # in the low bits only
    for values in (rng.choice(plain, 3000), np.concatenate([plain, alike, alike[::-1]]), plain[:1], plain[:0]):
        want = np.unique(values, return_index=True, return_inverse=True)
        assert all((a == b).all() for a, b in zip(suffixtree._distinct(values), want))
