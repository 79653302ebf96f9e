"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Counts of a text (words, capitals, symbols, repeats, lines ...) are turned into rates whose spread
hardly depends on their level (square roots and logarithms), damped so that a text of a few words
looks like an ordinary one. Each class is a normal distribution over them. Its covariance is
shrunk towards that of both classes together, and from there towards a multiple of the identity
(over statistics of unit variance); the score is the posterior probability from the difference of the
log densities, each by a Mahalanobis distance through a Cholesky factor that is computed once.

How much to shrink, and how far to flatten the difference, is chosen by the log loss of training
rows on models of the other folds' rows. Training is a sum over rows: counts, sums and products per
fold and class, which is all the driver sees, whatever the number of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import fold, map_rows
from canopy.llm.quality import measured
from canopy.session import materialize

THRESHOLD = 0.3
#: Amounts of shrinking that are tried: towards the common covariance, towards the identity; and divisors of the difference.
TOGETHER = (0.05, 0.2, 0.5, 0.9)
ROUND = (0.001, 0.01, 0.1)
FLATTEN = (1.0, 2.0, 4.0, 8.0)
FOLDS = 5
#: Words that damp a rate, as if a text had so many more without the thing counted.
DAMP = 10


def _rate(part: str, whole: str, damp: float = DAMP) -> Column:
    return F.sqrt(F.col(part) / (F.col(whole) + F.lit(float(damp))))


def statistics() -> dict[str, Column]:
    """The transformed statistics, as expressions over the measures of a text."""
    words = F.col("n_words")
    return {
        "size": F.log1p(words.cast("double")),
        "word_length": F.log((F.col("word_chars") + 5.0 * DAMP) / (words + float(DAMP))),
        "symbols": _rate("n_symbols", "n_words"),
        "marked": _rate("n_marks", "n_words"),
        "shouts": _rate("n_shouts", "n_words"),
        "capitals": _rate("n_upper", "n_letters", 5 * DAMP),
        "stops": _rate("n_stops", "n_words"),
        "variety": F.log((F.col("n_distinct") + 1.0) / (words + 1.0)),
        "echoes": _rate("n_echoes", "n_words"),
        "repeats": _rate("n_repeat_words", "n_words"),
        "same_lines": _rate("n_dup_lines", "n_lines", DAMP / 2),
        "lines": F.log((F.col("n_lines") + 1.0) / (words + float(DAMP))),
    }


#: The statistics in order.
NAMES = ("size", "word_length", "symbols", "marked", "shouts", "capitals", "stops", "variety", "echoes", "repeats", "same_lines", "lines")


@dataclass(frozen=True)
class Sums:
    """Row counts, sums and products per class (0 and 1)."""

    n: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def without(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.first - other.first, self.second - other.second)


@dataclass(frozen=True)
class Model:
    """Centre and scale of the statistics; per class the mean, Cholesky factor and log of share over volume."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    flatten: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for rows of statistics, before they are flattened."""
        z = (x - self.centre) / self.scale
        sides = []
        for c in (0, 1):
            solved = np.linalg.solve(self.factors[c], (z - self.means[c]).T)
            sides.append(self.logs[c] - 0.5 * (solved * solved).sum(0))
        return sides[1] - sides[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _probability(self.difference(x) / self.flatten)


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def build(sums: Sums, together: float, round_: float, flatten: float = 1.0) -> Model | None:
    """The discriminant of the sums; None if a class has no rows."""
    n = sums.n
    if not (n > 0).all():
        return None
    p = sums.first.shape[1]
    centre = sums.first.sum(0) / n.sum()
    spread = np.diag(sums.second.sum(0)) / n.sum() - centre**2
    scale = np.sqrt(np.where(spread > 1e-12, spread, 1.0))
    means = (sums.first / n[:, None] - centre) / scale
    own = np.stack([(sums.second[c] / n[c] - np.outer(sums.first[c], sums.first[c]) / n[c] ** 2) / np.outer(scale, scale) for c in (0, 1)])
    common = (own * n[:, None, None]).sum(0) / n.sum()
    factors, logs = [], []
    for c in (0, 1):
        mixed = (1 - together) * own[c] + together * common
        level = max(float(np.trace(mixed)) / p, 1e-6)
        factor = np.linalg.cholesky((1 - round_) * mixed + round_ * level * np.eye(p))
        factors.append(factor)
        logs.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(centre, scale, means, np.stack(factors), np.array(logs), flatten)


def _rows(batch: dict) -> np.ndarray:
    return np.array([batch[name] for name in NAMES], np.float64).T


def training_sums(labelled: DataFrame) -> dict[int, Sums]:
    """Sums per fold over rows (fold, label, statistics), added up task by task."""
    p = len(NAMES)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = _rows(batch)
            key = np.array(batch["fold"]) * 2 + np.array(batch["label"])
            for k in np.unique(key).tolist():
                own = x[key == k]
                found = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                total[k] = total.get(k, 0) + found
        size = 1 + p + p * p
        yield {
            "key": [k for k in total for _ in range(size)],
            "at": list(range(size)) * len(total),
            "total": [v for found in total.values() for v in found.tolist()],
        }

    added = map_rows(labelled.select("fold", "label", *NAMES), "key int, at int, total double", task)
    rows = added.groupBy("key", "at").agg(F.sum("total").alias("total")).collect()  # folds * 2 * (1 + p + p * p)
    whole: dict[int, np.ndarray] = {}
    for r in rows:
        whole.setdefault(r["key"], np.zeros(1 + p + p * p))[r["at"]] = r["total"]
    out = {}
    for f in sorted({k // 2 for k in whole}):
        sides = [whole.get(2 * f + c, np.zeros(1 + p + p * p)) for c in (0, 1)]
        out[f] = Sums(np.array([s[0] for s in sides]), np.stack([s[1 : 1 + p] for s in sides]), np.stack([s[1 + p :].reshape(p, p) for s in sides]))
    return out


def _added(parts: list[Sums]) -> Sums:
    return Sums(sum(s.n for s in parts), sum(s.first for s in parts), sum(s.second for s in parts))


def choose(labelled: DataFrame, sums: dict[int, Sums]) -> tuple[float, float, float]:
    """The shrinking and flattening with the least log loss over rows, each judged without its own fold."""
    settings = list(product(TOGETHER, ROUND))
    whole = _added(list(sums.values()))
    models = {f: [build(whole.without(own), *s) for s in settings] for f, own in sums.items()}
    width = len(settings) * len(FLATTEN)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        loss = np.zeros(width)
        for batch in batches:
            x, folds, label = _rows(batch), np.array(batch["fold"]), np.array(batch["label"])
            for f in np.unique(folds).tolist():
                own = folds == f
                sign = np.where(label[own] == 1, -1.0, 1.0)
                for i, model in enumerate(models[f]):
                    if model is not None:
                        odds = model.difference(x[own]) * sign
                        for j, flat in enumerate(FLATTEN):
                            loss[i * len(FLATTEN) + j] += np.logaddexp(0, odds / flat).sum()
        yield {"at": list(range(width)), "loss": loss.tolist()}

    rows = map_rows(labelled.select("fold", "label", *NAMES), "at int, loss double", task)
    found = {r["at"]: r["loss"] for r in rows.groupBy("at").agg(F.sum("loss").alias("loss")).collect()}
    best = min(range(width), key=lambda i: (found.get(i, 0.0), i))
    return (*settings[best // len(FLATTEN)], FLATTEN[best % len(FLATTEN)])


def train(labelled: DataFrame) -> Model | float:
    """The model of rows (fold, label, statistics); a plain share of label 1 if only one label occurs (0.5 if none)."""
    sums = training_sums(labelled)
    whole = _added(list(sums.values())) if sums else None
    if whole is None or not (whole.n > 0).all():
        return 0.5 if whole is None else float(whole.n[1] / whole.n.sum())
    together, round_, flatten = choose(labelled, sums)
    return build(whole, together, round_, flatten)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only ``text`` decides a score. Labels (0 or 1, by doc_id) of rows whose crc32(doc_id as text) mod 5
    is not 0 are learned from; other values, null labels and null ids are not, nor is a doc_id
    that is labelled both ways. Null texts count as empty ones and get a score like any other. Rows that
    repeat an id are scored, and counted in training, one by one.
    """
    stats = [statistics()[name].alias(name) for name in NAMES]
    found = measured(docs, text=text, keys=("doc_id",)).select("doc_id", fold("doc_id", FOLDS).cast("int").alias("fold"), *stats)
    found, _ = materialize(found, "statistics")
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(F.min(label).alias("label"), F.max(label).alias("_other")).where("label = _other").drop("_other")
    labelled, _ = materialize(found.where("fold <> 0").join(known, "doc_id").drop("doc_id"), "labelled")
    model = train(labelled)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x = _rows(batch)
            score = model.score(x) if isinstance(model, Model) else np.full(len(x), model)
            yield {"doc_id": batch["doc_id"], "fold": batch["fold"], "score": score.tolist()}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_rows(found, f"doc_id {kind}, fold int, score double", task)
    return scored.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
