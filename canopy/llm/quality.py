"""Quality rules by weak supervision.

Every rule looks at one measured quantity of a text and votes *keep*, *drop*, or abstains.
Expectation-maximisation over the vote patterns of the whole table estimates how often each
rule gives each vote for good documents and for those with each kind of fault, and how many
there are of each; a document is kept by its posterior probability of being good. No labels are used.

The driver sees the count of each vote pattern, of which there are at most 3 ** rules whatever the
size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import map_rows, words

SYMBOLS = b"#*$%&|<>"
GRAM = 8

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_lines long, n_letters long, n_upper long, n_stops long, n_shouts long, n_distinct long, n_marks long, n_echoes long"
)


def repeated_positions(ids: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """True where a word lies in a window of ``gram`` words that the text holds at least twice.

    Windows are told apart by a 64-bit hash of their words.
    """
    n = len(ids)
    covered = np.zeros(n, bool)
    if n <= gram:
        return covered
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        window = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            window = window * np.uint64(0xD6E8FEB86659FD93) + x[k : n - gram + 1 + k]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + gram, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of ``MEASURES``; all 0 for null."""
    found = words(text)
    if not found:
        return (0,) * 13
    raw = np.frombuffer(text, np.uint8)
    in_words = sum(map(len, found))
    # Bytes 10xxxxxx continue a code point; none of them is white space, so all are inside words.
    chars = in_words - int(np.count_nonzero((raw & 0xC0) == 0x80))
    seen: set[bytes] = set()
    lines = dups = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    letters = upper + int(np.count_nonzero((raw >= 97) & (raw <= 122)))
    stops = sum(w[-1] in b".?" for w in found)
    shouts = text.count(b"!")
    marks = sum(w[-1] in SYMBOLS for w in found)
    echoes = int(np.count_nonzero(ids[1:] == ids[:-1]))
    return (
        len(found), chars, symbols, dups, int(np.count_nonzero(repeated_positions(ids))),
        lines, letters, upper, stops, shouts, len(number), marks, echoes,
    )


def measured(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns and measures of every row; nothing else of the row is carried."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), MEASURES])
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = [measure(t) for t in batch["_text"]]
            out = {k: batch[k] for k in keys}
            yield out | dict(zip(names, zip(*rows) if rows else [()] * len(names)))

    return map_rows(docs.select(*keys, F.col(text).cast("binary").alias("_text")), schema, task)


@dataclass(frozen=True)
class Rule:
    """``value`` up to ``good`` votes keep, from ``bad`` on drops; between them, or null, it abstains.

    Rules with the same ``fault`` look for the same kind of bad document.
    """

    name: str
    fault: str
    value: Column
    good: float
    bad: float

    def vote(self) -> Column:
        low, high = sorted((self.good, self.bad))
        drop, keep = F.lit(-1), F.lit(1)
        below, above = (keep, drop) if self.good <= self.bad else (drop, keep)
        return F.when(self.value <= low, below).when(self.value >= high, above).otherwise(F.lit(0))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def default_rules() -> list[Rule]:
    return [
        Rule("length", "short", F.col("n_words").cast("double"), good=20, bad=10),
        Rule("repeats", "repetition", _share("n_repeat_words", "n_words"), good=0.10, bad=0.30),
        Rule("echoes", "repetition", F.when(F.col("n_words") >= 20, _share("n_echoes", "n_words")), good=0.10, bad=0.40),
        Rule("symbols", "symbols", _share("n_symbols", "n_words"), good=0.02, bad=0.25),
        Rule("word marks", "symbols", _share("n_marks", "n_words"), good=0.02, bad=0.20),
        Rule("same lines", "repetition", _share("n_dup_lines", "n_lines"), good=0.10, bad=0.30),
        Rule("capitals", "shouting", _share("n_upper", "n_letters"), good=0.20, bad=0.60),
        Rule("shouting", "shouting", _share("n_shouts", "n_words"), good=0.05, bad=0.30),
        Rule("sentences", "no prose", F.when(F.col("n_words") >= 20, _share("n_stops", "n_words")), good=0.02, bad=0.003),
        Rule("vocabulary", "repetition", F.when(F.col("n_words").between(20, 2000), _share("n_distinct", "n_words")), good=0.30, bad=0.10),
        Rule("word length", "no prose", _share("word_chars", "n_words"), good=9, bad=25),
    ]


@dataclass(frozen=True)
class Estimate:
    """Classes of documents: the good ones first, then those with each kind of fault.

    ``shares[class]`` of all documents; ``votes[rule, class, vote]`` for votes -1, 0, 1;
    ``fit`` is the mean log likelihood of a document, pseudo-votes included.
    """

    shares: np.ndarray
    votes: np.ndarray
    fit: float

    @property
    def prior(self) -> float:
        """Share of good documents."""
        return float(self.shares[0])

    @property
    def rates(self) -> np.ndarray:
        """``rates[rule, class, vote]`` of bad (0) and good (1) documents."""
        bad = np.average(self.votes[:, 1:], axis=1, weights=self.shares[1:])
        return np.stack([bad, self.votes[:, 0]], 1)

    def classes(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(class | votes) and log P(votes) for rows of votes."""
        logs = np.log(self.votes)
        rules = np.arange(votes.shape[1])
        joint = np.stack([logs[rules, c, votes + 1].sum(1) for c in range(len(self.shares))], 1) + np.log(self.shares)
        top = joint.max(1, initial=-np.inf)
        total = top + np.log(np.exp(joint - top[:, None]).sum(1))
        return np.exp(joint - total[:, None]), total

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes."""
        return self.classes(votes)[0][:, 0]


#: What is believed of votes (drop, abstain, keep) before any is seen: by a rule on good documents, by a
#: rule on documents with the fault that it looks for, and on documents with another fault.
ON_GOOD, ON_ITS_FAULT, ON_OTHERS = (0.02, 0.28, 0.70), (0.80, 0.10, 0.10), (0.25, 0.25, 0.50)
GOOD = 0.8
#: Weight of that belief as a share of the table, so that it counts the same in tables of any size.
BELIEF = 0.05
#: Chance to be good that the estimates start with for documents some rule votes to drop.
STARTS = (0.05, 0.3, 0.7)


def _maximise(votes: np.ndarray, share: np.ndarray, kinds: list[list[int]], start: float, rounds: int, tolerance: float) -> Estimate:
    """EM with one class of good documents and one for each kind of fault, a list of rules."""
    n_rules, n_classes = votes.shape[1], 1 + len(kinds)
    shares = np.array([GOOD, *[(1 - GOOD) / len(kinds)] * len(kinds)])
    belief = np.tile(np.array(ON_OTHERS), (n_rules, n_classes, 1))
    belief[:, 0] = ON_GOOD
    for c, members in enumerate(kinds, 1):
        belief[members, c] = ON_ITS_FAULT
    weight = BELIEF * shares
    result = Estimate(shares, belief, -np.inf)
    if not len(votes):
        return result
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    accused = np.stack([(votes[:, k] == -1).any(1) for k in kinds], 1).astype(float)
    blame = accused.sum(1, keepdims=True)
    good = np.where(blame > 0, start, 0.98)
    chance = np.hstack([good, (1 - good) * np.where(blame > 0, accused / np.maximum(blame, 1), 1 / len(kinds))])
    for _ in range(rounds):
        part = share[:, None] * chance
        rates = np.einsum("prv,pc->rcv", cast, part) + belief * weight[None, :, None]
        rates /= rates.sum(2, keepdims=True)
        found = (part.sum(0) + weight) / (1 + BELIEF)
        chance, logs = Estimate(found, rates, 0.0).classes(votes)
        fit = float(share @ logs + (belief * weight[None, :, None] * np.log(rates)).sum() + weight @ np.log(found))
        settled = fit - result.fit < tolerance
        result = Estimate(found, rates, fit)
        if settled:
            break
    return result


def estimate(votes: np.ndarray, counts: np.ndarray, faults: list[str] | None = None, rounds: int = 1000, tolerance: float = 1e-12) -> Estimate:
    """EM over vote patterns and their counts.

    ``faults`` names what each rule looks for; rules that look for one fault depend on each other, so
    that fault has a class of its own, in which their votes go together (none given: one for each rule).
    It is compared with one class for all faults. EM ends at the optimum next to its start, so each
    of the two starts from several points and the estimate with the best fit is returned. Only shares of
    the table enter, so a table and many copies of it give one estimate; an empty table gives the belief.
    """
    n_rules = votes.shape[1]
    names = list(range(n_rules)) if faults is None else faults
    apart = [[r for r in range(n_rules) if names[r] == name] for name in dict.fromkeys(names)]
    share = counts / max(1.0, counts.sum())
    tried = [
        _maximise(votes, share, kinds, start, rounds, tolerance) for kinds in ([list(range(n_rules))], apart) for start in STARTS
    ]
    return max(tried, key=lambda e: e.fit)


def quality(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, measures, ``base_failed``, ``posterior`` and ``kept`` for every row.

    Null or empty texts have no words and fail the base rules (fewer than 20 words, or over 30 %
    of the words in repeated windows of eight). Repeated rows count as often as they occur.
    """
    rules = default_rules() if rules is None else rules
    votes = [r.vote() for r in rules]
    code = reduce(lambda acc, v: acc * 3 + v + 1, votes, F.lit(0).cast("long"))
    # Measured twice, once for the counts and once with the rows: nothing is written in between.
    measures = measured(docs.select("text"), keys=()).select(code.alias("_pattern"))
    seen = measures.groupBy("_pattern").count().orderBy("_pattern").collect()  # at most 3 ** len(rules) rows
    pattern = np.array([r["_pattern"] for r in seen], np.int64)
    counts = np.array([r["count"] for r in seen], float)
    each = np.stack([pattern // 3**k % 3 - 1 for k in range(len(rules) - 1, -1, -1)], 1) if len(seen) else np.zeros((0, len(rules)), int)
    chance = estimate(each, counts, [r.fault for r in rules]).posterior(each)
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(int(p), float(c)) for p, c in zip(pattern, chance)], "_pattern long, posterior double"
    )
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (
        measured(docs, keys=keys).withColumn("_pattern", code)
        .join(F.broadcast(known), "_pattern")
        .drop("_pattern")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
