"""Session helpers: a local session for tests and benches, and the shared scratch folder.

Operators that iterate (closure, depth) or that must freeze a row order (numbering) cut
their lineage by writing a Parquet table below ``spark.checkpoint.dir``. Every executor of
a cluster can read that folder, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Runtime settings the operators profit from; a value the session was started with is kept.
TUNING = {
    # Split skewed shuffle partitions of a join even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort when every partition of the build side was measured to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def tune(spark: SparkSession) -> SparkSession:
    started_with = spark.sparkContext.getConf()
    for key, value in TUNING.items():
        if not started_with.contains(key):
            spark.conf.set(key, value)
    return spark


def side_by_side(spark: SparkSession, *tasks):
    """Run independent plan builders that start Spark jobs at the same time; their results in order."""
    keep_tags = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(keep_tags(t)) for t in tasks]]


def local_session(app: str = "canopy", cores: int | str = 8, memory: str = "16g", **conf) -> SparkSession:
    """A single-machine session. A cluster job brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Unset on a local master (tests, benches), a private folder is made and remembered in the
    session; unset on a cluster it is an error, since a machine-local folder would not be
    visible to the other executors.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/canopy/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """Write ``df`` to the scratch folder and read it back: the table and its row count.

    One job: the count is observed while the rows are written. The files give the optimizer
    real sizes, so its broadcast decisions on the result are checked ones.
    """
    path = scratch_path(df.sparkSession, name)
    seen = write_observed(df, path, rows=F.count(F.lit(1)))
    return df.sparkSession.read.schema(df.schema).parquet(path), seen["rows"]


def write_observed(df: DataFrame, path: str, dealt: tuple[str, int] | None = None, **metrics: Column) -> dict:
    """Write ``df`` to a new table, with ``dealt`` in so many buckets by that column; the aggregates observed on the way.

    A table in buckets is known by ``table_name`` until ``read_dealt`` has read it.
    """
    seen = Observation()
    observed = df.observe(seen, *[c.alias(m) for m, c in metrics.items()])
    if dealt is None:
        observed.write.parquet(path)
    else:
        by, buckets = dealt
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        df.sparkSession.sql(
            f"CREATE TABLE {table_name(path)} ({columns}) USING parquet CLUSTERED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        observed.write.insertInto(table_name(path))
    return seen.get


def table_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def read_dealt(spark: SparkSession, path: str) -> DataFrame:
    """A table written in buckets: joins of such tables by the column of the buckets move no rows.

    The catalog forgets the table; its files stay in the scratch folder.
    """
    rows = spark.table(table_name(path))
    spark.sql(f"DROP TABLE {table_name(path)}")
    return rows


def spread(scan: DataFrame, min_bytes: int = 1 << 20) -> DataFrame:
    """Rows of a file scan dealt out to all cores when its files allow fewer tasks than there are cores.

    Worth a shuffle in front of heavy per-row work on files that cannot be split. A scan that
    already has enough tasks, and so any large table, is returned as it is; so is a scan of
    less than ``min_bytes``.
    """
    execution = scan._jdf.queryExecution()
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if execution.optimizedPlan().stats().sizeInBytes() < min_bytes:
        return scan
    return scan.repartition(cores) if execution.toRdd().getNumPartitions() < cores else scan


def spread_by_size(scan: DataFrame, task_bytes: int = 8 << 20, by: str | None = None) -> DataFrame:
    """Rows of a file scan dealt out so that no task gets much more than ``task_bytes`` of the files.

    For work that makes many rows of each row and aggregates them in the same task: what one task
    has to hold then stays the same however large the files are. Few bytes are spread as by ``spread``;
    with ``by`` rows are always dealt out, those with one value of that column to one task.
    """
    tasks = -(-int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // task_bytes)
    if by is not None:
        return scan.repartition(max(tasks, scan.sparkSession.sparkContext.defaultParallelism), by)
    if tasks <= scan.sparkSession.sparkContext.defaultParallelism:
        return spread(scan)
    return scan.repartition(tasks)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through the file system that owns it (HDFS, object store, local)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them become invalid."""
    delete_path(spark, f"{scratch_root(spark)}/canopy/{spark.sparkContext.applicationId}")
