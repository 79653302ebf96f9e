"""New files become snapshots; new rows are inserted unless their key is known.

Both loads run what is there (``availableNow``) and end; started again they go on with the
files that arrived since. Every micro-batch may be run twice after a failure and then gives
the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.tables import insert_ignore
from canopy.session import delete_path
from canopy.sources.store import Store

MAX_FILES = 1_000


def file_stream(
    spark: SparkSession, folder: str, schema: str | T.StructType, glob: str = "*.parquet", max_files: int = MAX_FILES
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def load_snapshots(
    rows: DataFrame,
    store: Store,
    build: Callable[[DataFrame], Mapping[str, DataFrame]],
    checkpoint: str,
) -> None:
    """Every new file is a commit named by its whole path: build its tables and replace its tag.

    ``build`` gets a batch with a ``commit_id`` column and keeps that column in the tables it
    returns. A batch names at most ``max_files`` commits, which bounds the list the driver
    holds.
    """

    def batch(df: DataFrame, _: int) -> None:
        commits = [r["commit_id"] for r in df.select("commit_id").distinct().collect()]
        if commits:
            store.load_many(commits, build(df))

    named = rows.select("*", F.col("_metadata.file_path").alias("commit_id"))
    named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def load_new_keys(
    rows: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order: Sequence[str] | None = None
) -> None:
    """Append the first row of every key not stored by an earlier batch.

    The batch is reduced to one row per key inside the tasks before it is shuffled, so a hot
    key costs no more than any other; known keys live in the table, not in streaming state.
    A batch writes its own folder, which a repeated run overwrites.
    """
    keys = list(keys)
    spark, schema = rows.sparkSession, rows.schema

    def batch(df: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        delete_path(spark, target)
        if number:
            stored = read_new_keys(spark, path, schema).where(F.col("batch") < number)
        else:
            stored = spark.createDataFrame([], schema)
        insert_ignore(stored, df, keys, order).write.mode("overwrite").parquet(target)

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def read_new_keys(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)
