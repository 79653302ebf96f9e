"""A folder of Parquet tables, versioned by tag.

Tagged tables are partitioned by ``tag``, so a snapshot is read, replaced or removed without
touching the others. Which tags are live is kept in a log that is only ever appended to, one
small file per load or removal. A load first reserves its tags there, then writes its data, and
then, in one append, makes its new tag live and the old one of the commit dead. Readers see the
rows of live tags only, so never half a snapshot, and the tag of a load that failed is never
used again. Dead data is deleted afterwards. One writer at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.numbering import number_rows
from canopy.operators.tables import Key, TableDef, first_per_key, insert_ignore
from canopy.session import delete_path, path_exists
from canopy.sources.ranges import RANGE, Ranges, differing, digest_table, digests

TAGS = TableDef.of("tags", Key("tag:INTEGER"), "commit_id")
_TAG_LOG = TableDef.of("tag_log", "tag:INTEGER", "commit_id", "live:BOOLEAN")


_MARK = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|(\?)""")


def sql_with(spark: SparkSession, sql: str, args: Sequence) -> DataFrame:
    """``spark.sql`` with positional arguments, passed by name.

    Spark 4.1.2 mixes up the order of positional arguments from the fifth on.
    """
    number = itertools.count()
    named = _MARK.sub(lambda m: f":_p{next(number)}" if m.group(1) else m.group(0), sql)
    given = next(number)
    if given != len(args):
        raise ValueError(f"the statement has {given} marks, but {len(args)} arguments were given")
    return spark.sql(named, args={f"_p{i}": v for i, v in enumerate(args)}) if args else spark.sql(sql)


class Store:
    def __init__(
        self, spark: SparkSession, path: str, tables: Iterable[TableDef], fresh: bool = False, must_exist: bool = False,
        ranged: Mapping[str, Ranges] | None = None,
    ):
        """Open a store; ``fresh`` starts empty, ``must_exist`` fails unless it is there.

        ``ranged`` names the tables laid out in ranges, always with the same ``Ranges`` for one store.
        """
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {t.name: t for t in [*tables, TAGS]}
        self.ranged = dict(ranged or {})
        for name in self.ranged:
            if not self._tagged(name) or not self._range_keys(name):
                raise ValueError(f"table {name} needs a tag and further keys to be laid out in ranges")
        self.tables.update({t.name: t for t in map(digest_table, self.ranged)})
        if must_exist and not path_exists(spark, self.path):
            raise FileNotFoundError(f"no store at {self.path}")
        if fresh:
            self.drop_all()
        for name in self.tables:
            self._make(name)

    def _make(self, name: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(target)

    def _folder(self, name: str, tag: int | None = None) -> str:
        return f"{self.path}/{name}" + ("" if tag is None else f"/tag={tag}")

    def _tagged(self, name: str) -> bool:
        return name != "tags" and "tag" in self.tables[name].columns

    # Tables --------------------------------------------------------------------------------

    def read(self, name: str) -> DataFrame:
        if name == "tags":
            return self.tags()
        rows = self._stored(name)
        # The live tags reach the scan as a partition filter where they are few, else at run time.
        return rows.join(self.tags().select("tag"), "tag", "left_semi").select(*rows.columns) if self._tagged(name) else rows

    def _stored(self, name: str) -> DataFrame:
        table = self.tables[name]
        return self.spark.read.schema(table.schema).parquet(self._folder(name)).select(*table.columns)

    def _range_keys(self, name: str) -> list[str]:
        return [k for k in self.tables[name].keys if k != "tag"]

    def append(self, name: str, rows: DataFrame, order: Sequence[str] | None = None) -> None:
        """Add rows; of rows with equal keys, stored ones and then the least by ``order`` win.

        Rows of a tagged table belong to tags that are live already; only stored rows of those
        tags are compared.
        """
        table = self.tables[name]
        rows = table.conform(rows)
        if table.keys:
            stored = self._stored(name)
            if self._tagged(name):
                stored = stored.join(rows.select("tag").distinct(), "tag", "left_semi").select(*stored.columns)
            rows = insert_ignore(stored, rows, table.keys, order)
        if name not in self.ranged:
            self._write(name, rows, "append")
            return
        # Without digests a tag is compared as a whole, so a failure in between hides no difference.
        tags = [r["tag"] for r in rows.select("tag").distinct().collect()]  # one row per tag
        for tag in tags:
            delete_path(self.spark, self._folder(digest_table(name).name, tag))
        self._write(name, rows, "append")
        self._write_digests(name, tags)

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        if not self._tagged(name):
            rows.write.mode(mode).parquet(self._folder(name))
            return
        by = ["tag"]
        if name in self.ranged:
            rows = rows.withColumn(RANGE, self.ranged[name].folder(self._range_keys(name)))
            by.append(RANGE)
        # Rebalancing by tag gathers small tags into few files and splits large ones.
        rows = rows.hint("rebalance", *map(F.col, by))
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        writer.parquet(self._folder(name))

    def _write_digests(self, name: str, tags: Sequence[int]) -> None:
        """Digests of the rows that are there, for whole tags."""
        rows = self._stored(name).where(F.col("tag").isin(list(tags)))
        found = digests(rows, tags, self.ranged[name], self._range_keys(name))
        self._write(digest_table(name).name, found, "overwrite")

    def changed(self, name: str, before: str, after: str) -> tuple[DataFrame, DataFrame]:
        """The rows of two commits, without tag, that lie in ranges in which the commits differ.

        Rows of the other ranges are the same in both and are not read. The rows of a table
        without ranges, or of a tag without digests, are returned whole.
        """
        table = self.tables[name]
        columns = [c for c in table.columns if c != "tag"]
        tags = [self.tag_of(c) for c in (before, after)]
        if name not in self.ranged:
            rows = self.read(name)
            return tuple(rows.where(F.col("tag") == t).select(*columns) for t in tags)
        ranges, keys = self.ranged[name], self._range_keys(name)
        rows = self.spark.read.schema(table.schema.add(RANGE, "integer")).parquet(self._folder(name))
        found = differing(self._stored(digest_table(name).name), tags, ranges)
        if found is None:
            return tuple(rows.where(F.col("tag") == t).select(*columns) for t in tags)
        folders, leaves = found
        rows = rows.where(F.col(RANGE).isin(folders)).withColumn("_leaf", ranges.leaf(keys))
        rows = rows.join(leaves, "_leaf", "left_semi")
        return tuple(rows.where(F.col("tag") == t).select(*columns) for t in tags)

    def drop_all(self) -> None:
        """Empty every declared table."""
        for name in self.tables:
            delete_path(self.spark, self._folder(name))
            self._make(name)

    # SQL -----------------------------------------------------------------------------------

    def register(self) -> None:
        """Make every table a view of its own name."""
        for name in self.tables:
            self.read(name).createOrReplaceTempView(name)

    def query(self, sql: str, *args) -> DataFrame:
        """SQL over the stored tables; ``?`` marks take the arguments in order."""
        self.register()
        return sql_with(self.spark, sql, args)

    # Tags ----------------------------------------------------------------------------------

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_TAG_LOG.schema).parquet(self._folder("tags"))

    def _log_append(self, rows: list[tuple[int, str, bool | None]]) -> None:
        """Live, dead, or (null) reserved tags."""
        self.spark.createDataFrame(rows, _TAG_LOG.schema).coalesce(1).write.mode("append").parquet(self._folder("tags"))

    def tags(self) -> DataFrame:
        """Live tags. A tag is used once, so a dead one never comes back."""
        log = self._log()
        dead = log.where(~F.col("live")).select("tag")
        return log.where(F.col("live")).join(dead, "tag", "left_anti").select(*TAGS.columns)

    def _abandoned(self) -> DataFrame:
        """Tags that a load reserved and, since it failed, never made live."""
        log = self._log()
        settled = log.where(F.col("live").isNotNull()).select("tag")
        return log.where(F.col("live").isNull()).join(settled, "tag", "left_anti").select(*TAGS.columns)

    def tag_of(self, commit: str) -> int:
        found = self.tags().where(F.col("commit_id") == commit).select("tag").take(2)
        if len(found) != 1:
            raise LookupError(f"{len(found) or 'no'} tags for commit {commit!r}, expected one")
        return found[0]["tag"]

    def _next_tag(self) -> int:
        """One more than any tag ever used, dead ones included."""
        return 1 + self._log().agg(F.coalesce(F.max("tag"), F.lit(0))).first()[0]

    def remove_commit(self, commit: str) -> list[int]:
        """Remove every tag of a commit from all tables; the tags removed."""
        found = [tuple(r) for r in self.tags().where(F.col("commit_id") == commit).collect()]
        if found:
            self._log_append([(t, c, False) for t, c in found])
        self._delete([t for t, _ in found])
        return [t for t, _ in found]

    def _delete(self, tags: Iterable[int]) -> None:
        for tag in tags:
            for name in self.tables:
                if self._tagged(name):
                    delete_path(self.spark, self._folder(name, tag))

    def load(self, commit: str, tables: Mapping[str, DataFrame]) -> int:
        """Store a commit under a new tag, replacing what was loaded for it before.

        The given rows carry no tag yet. Keys are unique within the load (first row wins).
        """
        return self.load_many({commit: None}, tables)[commit]

    def load_many(self, commits: Iterable[str], tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Store several commits at once: one write per table, whatever the number of commits.

        With more than one commit the rows must have a ``commit_id`` column. The list of
        commits is held by the driver, so keep a call to some thousand.
        """
        commits = list(commits)
        first = self._next_tag()
        tags = {c: first + i for i, c in enumerate(commits)}
        old = [tuple(r) for r in self.tags().where(F.col("commit_id").isin(commits)).collect()]
        old += [tuple(r) for r in self._abandoned().collect()]
        self._log_append([(t, c, None) for c, t in tags.items()])
        named = self.spark.createDataFrame([(t, c) for c, t in tags.items()], TAGS.schema)
        for name, rows in tables.items():
            table = self.tables[name]
            if "commit_id" in rows.columns:
                rows = rows.join(named, "commit_id")
            elif len(commits) == 1:
                rows = rows.withColumn("tag", F.lit(first).cast("bigint"))
            else:
                raise ValueError(f"rows for {name} do not say which commit they belong to")
            rows = table.conform(rows)
            self._write(name, first_per_key(rows, table.keys) if table.keys else rows, "overwrite")
            if name in self.ranged:
                self._write_digests(name, list(tags.values()))
        self._log_append([(t, c, True) for c, t in tags.items()] + [(t, c, False) for t, c in old])
        self._delete(t for t, _ in old)
        return tags


def allocate_tags(tags: DataFrame, commits: DataFrame) -> DataFrame:
    """New (tag, commit_id) rows for the commits without a tag, numbered on from the largest tag.

    For long lists of commits; ``Store.load_many`` allocates the tags of a load itself.
    """
    new = commits.select("commit_id").distinct().join(tags.select("commit_id"), "commit_id", "left_anti")
    numbered = number_rows(new, ["commit_id"], name="_n")
    last = tags.agg(F.coalesce(F.max("tag"), F.lit(0)).cast("bigint").alias("last"))
    return numbered.select((F.col("_n") + last.scalar()).alias("tag"), "commit_id")
