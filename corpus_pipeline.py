"""A corpus run over ``documents``: language, quality, near-duplicates, mixing, tokens.

Every stage reads the table its predecessor wrote and returns the columns of ``documents``, but
for the last, which returns each kept document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, langid, minhash, mixing, quality
from canopy.llm.common import fold, table
from canopy.llm.queries import tokenizer_path
from canopy.session import materialize

#: Similarity of the five-word shingles from which documents are near copies.
NEAR_PERCENT = 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Compression, EM, sketches and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and narrow decisions go."""
    found = langid.identify(docs, fold("doc_id") != 0, keep=COLUMNS)
    return found.where("NOT rejected").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good."""
    return quality.quality(docs, keys=COLUMNS).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; the others go.

    Rows that repeat both id and text are one document. Different texts under one id are documents
    of their own: all but one of them are numbered above all ids for the comparison. Rows without id
    belong to no group and stay.
    """
    digest = F.coalesce(F.md5("text"), F.lit("~"))  # a null text comes last
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id")
    ids = ids.agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("_low"), F.max(digest).alias("_high")).where("n > 1")
    repeated, n = materialize(ids, "repeated")
    marked = docs.withColumn("_own", F.col("doc_id"))
    if n:
        again = docs.join(repeated.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        first = repeated.select("doc_id", "_low")
        top = docs.agg(F.max("doc_id")).first()[0]
        number = F.when(digest == F.col("_low"), F.col("doc_id")).otherwise(F.lit(top) + 1 + F.monotonically_increasing_id())
        again, _ = materialize(again.join(first, "doc_id").withColumn("_own", number).drop("_low"), "again")
        marked = marked.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(again)
    found = minhash.near_duplicates(marked.select("_own", "text"), doc_id="_own", percent=NEAR_PERCENT)
    found, _ = materialize(found.where("NOT kept").select(F.col("doc_id").alias("_own")), "near")
    return marked.join(found, "_own", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and packed ids of every document."""
    return bpe.tokenize(docs, bpe.read_spec(tokenizer_path()), keep=("doc_id", "source"))


STAGES = [
    ("language", language),
    ("quality", rules),
    ("near duplicates", deduplicate),
    ("mixing", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
