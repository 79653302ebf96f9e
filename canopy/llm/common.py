"""Shared by the operators: input columns, the fold of a document, the map over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from canopy.session import tune

#: What a word is in all operators: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of the provided tables that the operators read, with the types they are read as.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


#: Runtime settings of the operators; a value the session was started with is kept. Results that are
#: used again are written as tables, so shuffle files may go when their job is over; small batches
#: bound what a Python worker holds of long texts.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    started_with = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if not started_with.contains(key):
            spark.conf.set(key, value)
    return tune(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Results that are used again are written as tables; the shuffles behind them are freed when the
    driver collects its garbage, which it may not do for long while the disks of the executors fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text. ``bytes.split`` without arguments splits at exactly the ASCII white space."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.lower`` changes no other character."""
    return text.lower().split() if text else []


def give_back() -> None:
    """Return freed memory of this worker to the system: workers outlive a task and serve the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # where the C library has it
        trim(0)


def map_rows(df: DataFrame, schema: str, task: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for a task that takes and gives dicts of column lists, batch by batch."""
    prepare(df.sparkSession)
    fields = _parse_datatype_string(schema)
    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches)
        for out in task(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds)], names=names)
        del columns
        give_back()

    return df.mapInArrow(run, schema)
