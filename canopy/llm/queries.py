"""The operators over the provided tables, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, discriminant, embeddings, langid, licenses, minhash, mixing, periodic, quality, suffixtree, transcripts, whitening, wrapper
from canopy.llm.common import fold, table
from canopy.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rules and the weak-supervision verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


_MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
    SELECT source, SUM(size)::HUGEINT AS s,
           [1, 2, 3][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w
    FROM sized GROUP BY source
), before AS (
    SELECT *, SUM(s) OVER () AS total, SUM(w) OVER () AS all_w,
           COALESCE(SUM(3 * s) OVER up, 0) AS full_s, COALESCE(SUM(w) OVER up, 0) AS full_w
    FROM per_source
    WINDOW up AS (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
    SELECT *, 3 * s * (all_w - full_w) < w * (total - full_s) AS is_full FROM before
), level AS (
    SELECT MAX(total) - COALESCE(SUM(3 * s) FILTER (is_full), 0) AS rest,
           MAX(all_w) - COALESCE(SUM(w) FILTER (is_full), 0) AS open_w
    FROM marked
), targets AS (
    SELECT source, s::BIGINT AS source_size,
           CASE WHEN is_full THEN (3 * s)::DOUBLE
                WHEN rest = 0 THEN 0.0
                ELSE w::DOUBLE * rest::DOUBLE / open_w::DOUBLE END AS target
    FROM marked, level
), rated AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN LEAST(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
           ('0x' || substr(md5('mix-1:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""


@query(_MIX_SQL)
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and the words that makes."""
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.read_spec(tokenizer_path()))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression; documents of fold 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.withColumn("held_out", fold("doc_id") == 0), ~F.col("held_out"), keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


@query()
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-tree and unigram scores of every document; documents of fold 1 are held out."""
    return suffixtree.scored(table(spark, sf_dir, "documents"), fold("doc_id") == 1)


@query()
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.main_text(table(spark, sf_dir, "pages"))


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document, one row per paragraph that is one."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query()
def op2_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and roles of all conversations recovered from raw transcripts, the turns in canonical form.

    The transcripts are written from the given turns, without every fourth speaker marker; where a turn
    begins and ends is the model's finding.
    Probabilities are counted on conversations whose crc32(conv_id as text) mod 5 is not 0.
    """
    turns = table(spark, sf_dir, "conversations")
    lines = transcripts.transcripts(turns)
    training = fold("conv_id") != 0
    counted = transcripts.labelled_turns(turns.where(training), transcripts.featured(lines.where(training)))
    model = transcripts.train(counted)
    numbered = lines.select("conv_id", (F.col("turn") * (1 << 20) + F.col("k")).alias("pos"), "line")
    found = transcripts.parse(numbered, model)
    return transcripts.recovered(found).select(
        "conv_id", "turn", (fold("conv_id") == 0).alias("held_out"), "role", "first_pos", "n_lines",
        transcripts.rendered(F.col("role"), F.col("text")).alias("rendered"),
    )


def planted_period(row: dict, found: list[bytes]) -> list[bytes]:
    """The words as the query looks at them: every tenth document, by hash, repeats itself from some word on."""
    h = zlib.crc32(b"" if row["doc_id"] is None else str(row["doc_id"]).encode())
    n, g = len(found), h // 10
    if h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + i % p] for i in range(n - a)]


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words: their number, the longest, and digests of all and of the collapsed text."""
    return periodic.summary(table(spark, sf_dir, "documents"), edit=planted_period)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of fold 0 are held out."""
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
