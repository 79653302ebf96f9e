"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source, a share is worked out for every source, and a document is emitted
``floor(rate)`` times plus once more with probability equal to the rest of the rate, where the
draw is a hash of the seed and the document's id. Reruns and retried tasks therefore agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import WORD
from canopy.operators.numbering import number_rows
from canopy.session import materialize

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"

_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed and key only (52 bits of an MD5). A null key is a key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources in code point order, null last, get the weights in turn. The whole size is shared by
    weight; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight until no target is above. A source without words has target and rate 0. The table of
    sources is summed up inside Spark; the driver sees one row of sums per sharing round.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(per_source, [F.col("source").isNull(), "source"], name="_place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources, _ = materialize(
        numbered.select("source", "source_size", turn.cast("long").alias("_weight"), (F.col("source_size") * cap).alias("_most")),
        "sources",
    )

    def sums(rows: DataFrame) -> tuple[int, int, int]:
        row = rows.agg(
            F.sum(F.col("source_size").cast(_WIDE)), F.sum(F.col("_weight").cast(_WIDE)), F.count(F.lit(1))
        ).first()
        return int(row[0] or 0), int(row[1] or 0), row[2]

    total, weight, _ = sums(sources)
    rest, open_weight, n_full = total, weight, -1
    full = F.lit(False)
    while rest and open_weight:
        full = F.col("_most").cast(_WIDE) * F.lit(open_weight).cast(_WIDE) < F.col("_weight").cast(_WIDE) * F.lit(rest).cast(_WIDE)
        full_size, full_weight, now = sums(sources.where(full))
        if now == n_full:
            break
        rest, open_weight, n_full = total - cap * full_size, weight - full_weight, now
    shared = F.col("_weight").cast("double") * F.lit(float(rest)) / F.lit(float(open_weight or 1))
    target = F.when(full, F.col("_most").cast("double")).otherwise(shared)
    size = F.col("source_size")
    rate = F.when(size > 0, F.least(target / size, F.lit(float(cap)))).otherwise(F.lit(0.0))
    return sources.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """How often a document is emitted."""
    whole = F.floor(rate)
    return (whole + (draw(key, seed) < rate - whole).cast("long")).cast("int")


def mixed(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with each row emitted as often as the mix takes it; same columns, any others included.

    Null texts have size 0, a null source is a source of its own, rows with equal ids (null too)
    share one draw. An empty table gives an empty table. Only (source, size) is aggregated; the
    rates reach the documents by a join on the source whose small side Spark measures.
    """
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rates = source_targets(sized, weights, cap).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    taken = copies(F.col("_mix_rate"), F.col(doc_id), seed)
    joined = docs.join(rates, docs[source].eqNullSafe(F.col("_mix_source")))
    again = F.explode(F.array_repeat(F.lit(0), taken))
    return joined.withColumn("_mix_copy", again).drop("_mix_source", "_mix_rate", "_mix_copy")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sized, _ = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rates = source_targets(sized.select("source", "size"), weights, cap).withColumnRenamed("source", "_source")
    n = copies(F.col("rate"), F.col("doc_id"), seed)
    return sized.join(rates, sized["source"].eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken")
    )
