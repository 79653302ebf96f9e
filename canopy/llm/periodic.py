"""Periodic runs of words: maximal stretches that repeat themselves.

A run is a stretch of consecutive words with smallest period ``q``, at least ``max(12, 2 q)`` words
long, that no neighbouring word extends keeping the period. The runs are found through Lyndon
words: a run holds a Lyndon word of length ``q`` (its root) that is the longest Lyndon word at
its place, under the order of the words or under the reversed order. So the steps are

1. *Grouping*, the first phase of Baier's suffix sorter: suffixes are grouped by first word, the
   groups are taken from the highest down, and each hands its members' context on to the nearest
   suffixes before them in lower groups. When a group's turn comes, its context is the longest
   Lyndon word at each of its members. Done once for each of the two orders.
2. *Extension*: the place ``i`` and the place ``i + q`` behind its Lyndon word are compared to the
   right and to the left (longest common extensions, by prefix sums of a polynomial hash and
   binary search, for all places at once). Extensions of ``q`` words or more together make a run.
3. *Proof*: the hash can only overstate an extension. Every run to be reported is compared word by
   word; if one fails, its chunk is extended by exact comparison instead.

Each word of a run lies in a window of six words that its text holds at least twice, so only
stretches covered by such windows go through the steps. Many documents go through them together,
kept apart by separators that occur once. Work and memory are linear in a chunk of documents
(``CHUNK_WORDS`` words, or one longer document); documents need nothing of each other, so there is
no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import map_rows, words

#: A run has at least so many words; half of it is the window that covers every run twice.
LEAST = 12
WINDOW = LEAST // 2
#: Documents are worked on together up to so many words.
CHUNK_WORDS = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by Baier's grouping.

    ``ranks`` are dense numbers from 0 in the order of the symbols.
    """
    n = len(ranks)
    kinds = max(ranks) + 1 if n else 0
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    context = [1] * kinds  # length of the prefix that the members of a group share
    lower, upper = list(range(-1, kinds - 1)), list(range(1, kinds + 1))  # the groups as a list
    group = list(ranks)
    lengths = [0] * n
    # Place i is known as i + 1 here. A place leads to itself until its group had its turn, then to
    # the place before; 0 ends every way. Ways are halved as they are walked.
    way = list(range(n + 1))
    now = kinds - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = []
        shared = context[now]
        for i in own:
            lengths[i] = shared
            way[i + 1] = i
        hits: dict[int, int] = {}
        for i in own:
            while (up := way[i]) != i:
                way[i] = i = way[up]
            if i:
                hits[i] = hits.get(i, 0) + 1
        # Suffixes that were hit equally often leave their group for one right above it; those hit
        # most often end up highest.
        parted: dict[tuple[int, int], list[int]] = {}
        for j, times in hits.items():
            parted.setdefault((times, group[j - 1]), []).append(j - 1)
        for times, old in sorted(parted, reverse=True):
            new, above = len(members), upper[old]
            moved = parted[times, old]
            members.append(moved)
            context.append(context[old] + times * shared)
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above < len(lower) - 1:
                lower[above] = new
            for j in moved:
                group[j] = new
        now = lower[now]
    return lengths


def covered(ids: np.ndarray, document: np.ndarray) -> np.ndarray:
    """True where a word lies in a window of ``WINDOW`` words that its document holds at least twice.

    Windows are told apart by 64-bit hashes; equal hashes of different windows only let more through.
    """
    n = len(ids)
    found = np.zeros(n, bool)
    if n < WINDOW:
        return found
    window = document[: n - WINDOW + 1].astype(np.uint64) * _MIX
    symbol = _symbols(ids)
    for k in range(WINDOW):
        window = window * _BASE + symbol[k : n - WINDOW + 1 + k]
    whole = document[: n - WINDOW + 1] == document[WINDOW - 1 :]
    starts = np.flatnonzero(whole)
    order = starts[np.argsort(window[starts], kind="stable")]
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n + 1, np.int64)
    marked = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    twice[marked] += 1
    twice[marked + WINDOW] -= 1
    return np.cumsum(twice[:-1]) > 0


def _symbols(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extensions(x: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far places ``i`` and ``i + q`` agree to the left (before them) and to the right; at least."""
    n = len(x)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_symbols(x) * power[:-1])])
    j, shift = i + q, power[q]
    left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        far = np.minimum(right + step, n - j)
        agree = (prefix[i + far] - prefix[i]) * shift == prefix[j + far] - prefix[j]
        right = np.where((right + step <= n - j) & agree, right + step, right)
        far = np.minimum(left + step, i)
        agree = (prefix[i] - prefix[i - far]) * shift == prefix[j] - prefix[j - far]
        left = np.where((left + step <= i) & agree, left + step, left)
        step >>= 1
    return left, right


def _exact_extensions(x: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without hashes: the first disagreement on either side, period by period."""
    left, right = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    for period in np.unique(q).tolist():
        at = np.flatnonzero(q == period)
        differ = np.concatenate([[-1], np.flatnonzero(x[:-period] != x[period:]), [len(x) - period]])
        left[at] = i[at] - 1 - differ[np.searchsorted(differ, i[at]) - 1]
        right[at] = differ[np.searchsorted(differ, i[at])] - i[at]
    return left, right


def runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All (start, end, period) of runs of at least ``least`` symbols in a sequence of integers."""
    kinds, ranks = np.unique(x, return_inverse=True)
    places, periods = [], []
    for order in (ranks, len(kinds) - 1 - ranks):
        q = np.array(lyndon_lengths(order.tolist()), np.int64)
        i = np.arange(len(x))
        # A run holds a root whose first word is repeated right behind it.
        i = i[i + q < len(x)]
        i = i[x[i] == x[i + q[i]]]
        places.append(i)
        periods.append(q[i])
    i, q = np.concatenate(places), np.concatenate(periods)
    for extend in (_extensions, _exact_extensions):
        left, right = extend(ranks, i, q)
        start, end = i - left, i + q + right
        long = end - start >= np.maximum(least, 2 * q)
        found = np.unique(np.stack([start[long], q[long], end[long]], 1), axis=0).tolist()
        if all(np.array_equal(x[s : e - p], x[s + p : e]) for s, p, e in found):
            break
    return [(s, e, p) for s, p, e in found]


def runs_of_documents(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, end, period) of each document's words, sorted by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for found in texts for w in found], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    document = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(covered(ids, document))
    if not len(at):
        return out
    # Stretches of covered words of one document; those shorter than a run go.
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(document[at]) != 0)) + 1
    edges = np.concatenate([[0], breaks, [len(at)]])
    kept = np.repeat(np.diff(edges) >= LEAST, np.diff(edges))
    first = np.zeros(len(at), bool)
    first[edges[:-1]] = True
    at, first = at[kept], np.flatnonzero(first[kept])
    if not len(at):
        return out
    # A separator of its own before each stretch; ``at`` keeps pace to find the words again.
    joined = np.insert(ids[at], first, len(number) + np.arange(len(first)))
    at = np.insert(at, first, -1)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for start, end, period in runs(joined):
        place = int(at[start])
        doc = int(document[place])
        start_word = place - int(offsets[doc])
        out[doc].append((start_word, start_word + end - start, period))
    return [sorted(r, key=lambda t: (t[0], t[2])) for r in out]


def kept_words(found: list[bytes], repeats: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not repeats:
        return found
    edge = np.zeros(len(found) + 1, np.int64)
    for start, end, period in repeats:
        edge[start + period] += 1
        edge[end] -= 1
    stays = np.cumsum(edge[:-1]) == 0
    return [found[i] for i in np.flatnonzero(stays).tolist()]


def _chunks(batch: dict, keys: tuple[str, ...], edit: Callable | None) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    rows, texts, size = [], [], 0
    for row, text in enumerate(batch["_text"]):
        found = words(text)
        if edit is not None:
            found = edit({k: batch[k][row] for k in keys}, found)
        rows.append(row)
        texts.append(found)
        size += len(found)
        if size >= CHUNK_WORDS:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _mapped(docs: DataFrame, text: str, keys: tuple[str, ...], edit: Callable | None, schema: str, emit: Callable) -> DataFrame:
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for rows, texts in _chunks(batch, keys, edit):
                picked, columns = emit(texts, runs_of_documents(texts))
                yield {k: [batch[k][rows[i]] for i in picked] for k in keys} | columns

    return map_rows(docs.select(*keys, F.col(text).cast("binary").alias("_text")), f"{fields}, {schema}", task)


def periodic_runs(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), edit: Callable | None = None) -> DataFrame:
    """Key columns with start, length and period (in words) of every run: one row per run.

    Null, empty and blank texts have no words and no runs. Rows are judged one by one, so repeated
    rows give repeated results. ``edit``, if given, takes the key columns and the words of a row and
    gives the words to look at.
    """

    def emit(texts, found):
        flat = [(i, r) for i, repeats in enumerate(found) for r in repeats]
        columns = {"start": [s for _, (s, _, _) in flat], "length": [e - s for _, (s, e, _) in flat], "period": [p for *_, (_, _, p) in flat]}
        return [i for i, _ in flat], columns

    return _mapped(docs, text, keys, edit, "start long, length long, period long", emit)


def collapse(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), edit: Callable | None = None) -> DataFrame:
    """Key columns, n_runs and the collapsed text of every row: each run is reduced to its first period.

    Kept words are joined by one space; a null text becomes the empty text.
    """

    def emit(texts, found):
        joined = [b" ".join(kept_words(t, r)).decode("utf-8", "replace") for t, r in zip(texts, found)]
        return range(len(texts)), {"n_runs": [len(r) for r in found], "collapsed": joined}

    return _mapped(docs, text, keys, edit, "n_runs long, collapsed string", emit)


SUMMARY = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def summary(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), edit: Callable | None = None) -> DataFrame:
    """Key columns with the number of runs, the longest one, and digests, for every row.

    The longest run (of equally long ones that with the smallest start, then period) has start,
    length, period and exponent_milli, the length in thousandths of the period; without a run they
    are null. ``runs_sha256`` is of ``start,length,period`` and a line feed per run;
    ``collapsed_sha256`` of the collapsed text.
    """

    def emit(texts, found):
        rows = []
        for own, repeats in zip(texts, found):
            listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in repeats).encode()
            best = min(((s - e, s, p) for s, e, p in repeats), default=None)
            longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
            kept = b" ".join(kept_words(own, repeats))
            rows.append((len(repeats), *longest, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
        names = [part.split()[0] for part in SUMMARY.split(", ")]
        return range(len(texts)), dict(zip(names, map(list, zip(*rows))))

    return _mapped(docs, text, keys, edit, SUMMARY, emit)
