"""Language identification by compression.

For each language a raw-content dictionary is cut out of labelled training texts. A text is
compressed, piece by piece, once with each dictionary; the language whose dictionary leaves the
fewest bytes wins. Where the runner-up is almost as good the text is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import map_rows
from canopy.session import materialize

UNKNOWN = "und"
#: Bounds of the training sample, per language: texts, and characters taken from each.
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 500
PIECE = 1024
LEVEL = 3
MARGIN = 0.01

_LETTER = regex.compile(r"\p{L}")
_JUNK = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-cased words of letters, one space between them: what is compressed."""
    return _JUNK.sub(" ", text.lower()).strip()


def training_sample(docs: DataFrame, is_training: Column, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw dictionary content per language, from at most ``texts`` texts of ``chars`` characters each.

    Only ``text`` and non-null ``lang`` of training rows are read. Which rows are taken, and
    where the slice of a text begins, are decided by a hash of the text, so copies of one text
    are one candidate and reruns agree.
    """
    rows = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("_h")
    )
    counts, _ = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")), "langs")
    # A hash threshold leaves about 2 * texts rows per language before anything is gathered. Texts
    # stay where they are: only (lang, hash) is joined and ranked, then the few chosen texts are looked up.
    share = F.least(F.lit(1.0), F.lit(2.0 * texts) / F.col("_n"))
    few = rows.select("lang", "_h").join(counts, "lang").where(F.col("_h") < share * float(1 << 40)).select("lang", "_h").distinct()
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
    ranked, _ = materialize(ranked.where(F.col("_rank") <= texts).select("lang", "_h"), "chosen")
    start = F.pmod(F.col("_h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    found = rows.join(ranked, ["lang", "_h"]).select("lang", "_h", F.substring("text", start, F.lit(chars)).alias("_slice"))
    chosen = found.groupBy("lang", "_h").agg(F.min("_slice").alias("_slice")).orderBy("lang", "_h").collect()
    content: dict[str, list[str]] = {}
    for row in chosen:
        content.setdefault(row["lang"], []).append(plain(row["_slice"]))
    return {lang: " ".join(p for p in parts if p).encode() for lang, parts in content.items()}


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL, piece: int = PIECE):
        self.langs = sorted(content)
        self.piece = piece
        self._plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self._with = []
        for lang in self.langs:
            if len(content[lang]) < 8:  # the library takes no shorter dictionary
                self._with.append(self._plain)
                continue
            words = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            self._with.append(zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = plain(text).encode()
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self._with]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). The margin is what the runner-up needs more, as a share of
        the best size (of no dictionary at all, if only one language was learned); the score is
        that share put into [0, 1). Equal sizes go to the first language in order."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1 :] or [sum(len(self._plain.compress(plain(text).encode())) for _ in (0,))]
        margin = max(0.0, (min(others) - sizes[best]) / max(1, sizes[best]))
        return self.langs[best], margin / (margin + 0.1), margin


def identify(
    docs: DataFrame,
    is_training: Column,
    margin: float = MARGIN,
    texts: int = SAMPLE_TEXTS,
    chars: int = SAMPLE_CHARS,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` with lang_pred, score, margin and rejected for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is every
    text if nothing was learned. The dictionaries have at most ``texts * chars`` characters per
    language and travel with the tasks.
    """
    content = training_sample(docs, is_training, texts, chars)
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        classifier = Classifier(shipped.value)
        for batch in batches:
            rows = [classifier.predict(t) for t in batch["_text"]]
            found = dict(zip(("lang_pred", "score", "margin"), map(list, zip(*rows)) if rows else ([], [], [])))
            found["rejected"] = [p == UNKNOWN or m < margin for p, _, m in rows]
            yield {k: batch[k] for k in keep} | found

    return map_rows(docs.select(*keep, F.col("text").alias("_text")), f"{schema}, lang_pred string, score double, margin double, rejected boolean", task)
