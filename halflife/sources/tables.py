"""Versioned Parquet tables in a folder: the catalog's storage, change log, snapshots, indexes and retention."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halflife.operators import writes
from halflife.schema import CHANGES, EngineError

MANIFEST = T.StructType([T.StructField("table", T.StringType()), T.StructField("version", T.LongType()), T.StructField("created_at", T.LongType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())])
LOG = T.StructType([*CHANGES.fields, T.StructField("crc", T.LongType())])
#: Kinds of manifest rows that hold a whole table.
WHOLE = ("version", "snapshot", "restore")
KEEP = 48
#: Manifest files beyond which they are written into one.
MANIFEST_FILES = 64


class Tables:
    """Tables under a root that any Hadoop file system may hold; one process writes, others may read.

    A whole version, a batch of changes or an index is written first and then named in the manifest, under one
    rising number a table: readers see it wholly or not at all, and a failed write leaves a folder that nobody reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def manifests(self, table: str | None = None) -> DataFrame:
        """All rows ever noted, but for versions whose files prune() or truncate_log() removed."""
        path = f"{self.root}/_manifest"
        rows = self.spark.read.schema(MANIFEST).json(path).distinct() if self._exists(path) else self.spark.createDataFrame([], MANIFEST)
        rows = rows.where(F.col("table") == table) if table else rows
        gone = F.max(F.when(F.col("kind") == "pruned", 1).otherwise(0)).over(Window.partitionBy("table", "version"))
        return rows.withColumn("gone", gone).where("gone = 0 or kind = 'drop'").drop("gone")

    def _note(self, table: str, version: int, path: str, kind: str, at: int | None) -> None:
        row = [(table, version, int(time.time() * 1000) if at is None else at, path, kind)]
        folder = f"{self.root}/_manifest"
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(folder)
        fs, p = self._path(folder)
        files = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        if len(files) > MANIFEST_FILES:
            # The rows stand twice until the old files are gone; manifests() takes each once.
            held = self.spark.createDataFrame(self.spark.read.schema(MANIFEST).json(files).distinct().collect(), MANIFEST)
            held.coalesce(1).write.mode("append").json(folder)
            for f in files:
                self._delete(f)

    def next_number(self, table: str) -> int:
        path = f"{self.root}/_manifest"
        rows = self.spark.read.schema(MANIFEST).json(path).where(F.col("table") == table) if self._exists(path) else self.spark.createDataFrame([], MANIFEST)
        last = rows.agg(F.max("version")).first()[0]
        return 0 if last is None else last + 1

    def current(self, table: str, at: int | None = None) -> T.Row | None:
        """The newest whole version, or the newest not later than a time."""
        rows = self.manifests(table).where(F.col("kind").isin(*WHOLE, "drop"))
        if at is not None:
            rows = rows.where(F.col("created_at") <= at)
        row = rows.orderBy(F.desc("version")).first()
        return None if row is None or row["kind"] == "drop" else row

    def exists(self, table: str) -> bool:
        return self.current(table) is not None

    def read(self, table: str, at: int | None = None, skip_corrupt: bool = False) -> DataFrame:
        """The newest whole version, or that of a time; with skip_corrupt, files that cannot be read are passed over."""
        row = self.current(table, at)
        if row is None:
            raise EngineError(f"no table {table!r}")
        return self.spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(row["path"])

    def write(self, table: str, rows: DataFrame, kind: str = "version", at: int | None = None, partition_by: list[str] | None = None) -> int:
        version = self.next_number(table)
        path = f"{self.root}/{table}/v{version}-{uuid.uuid4().hex[:8]}"
        writer = rows.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        self._note(table, version, path, kind, at)
        return version

    def drop(self, table: str) -> None:
        """The table is gone from the catalog; its files stay until prune()."""
        if self.current(table) is None:
            raise EngineError(f"no table {table!r}")
        self._note(table, self.next_number(table), "", "drop", None)

    def snapshot(self, table: str, at: int | None = None) -> int:
        """A copy of the current version that later writes do not touch."""
        return self.write(table, self.read(table), "snapshot", at)

    def snapshots(self, table: str) -> DataFrame:
        return self.manifests(table).where("kind = 'snapshot'").orderBy("version")

    def restore(self, table: str, at: int) -> int:
        """The version of a point in time becomes the current one; the present one is kept as a snapshot first."""
        then = self.read(table, at)
        self.snapshot(table)
        return self.write(table, then, "restore")

    def _prune(self, table: str, rows) -> int:
        for row in rows:
            self._note(table, row["version"], "", "pruned", None)
            self._delete(row["path"])
        return len(rows)

    def prune(self, table: str, keep: int = KEEP) -> int:
        """Removes the files of all but the newest whole versions, which no time then names; returns how many."""
        whole = self.manifests(table).where(F.col("kind").isin(*WHOLE)).orderBy(F.desc("version")).collect()
        return self._prune(table, whole[keep:])

    def truncate_log(self, table: str) -> int:
        """Removes the change batches, and indexes, that are older than the oldest whole version kept; returns how many."""
        rows = self.manifests(table)
        oldest = rows.where(F.col("kind").isin(*WHOLE)).agg(F.min("version")).first()[0]
        return self._prune(table, rows.where(F.col("kind").isin("log", "index") & (F.col("version") < (oldest or 0))).collect())

    # The change log: one folder a batch, ordered by lsn and not by file.
    def log_batches(self, table: str, after: int = -1, at: int | None = None) -> list[T.Row]:
        rows = self.manifests(table).where((F.col("kind") == "log") & (F.col("version") > after))
        return (rows if at is None else rows.where(F.col("created_at") <= at)).orderBy("version").collect()

    def log(self, table: str, after: int = -1, at: int | None = None) -> DataFrame:
        """The changes of the batches numbered after `after` and noted not later than at."""
        paths = [r["path"] for r in self.log_batches(table, after, at)]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else writes.with_checksum(self.spark.createDataFrame([], CHANGES))

    def append_changes(self, table: str, changes: DataFrame, at: int | None = None) -> int:
        """Adds a batch of changes with checksums; lsn is the batch's number where changes have none. Returns the number."""
        number = self.next_number(table)
        named = {f.name: f.dataType.simpleString() for f in CHANGES.fields}
        lsn = F.coalesce("lsn", F.lit(number)) if "lsn" in changes.columns else F.lit(number)
        given = changes.withColumn("lsn", lsn.cast("long"))
        rows = given.select(*[(F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in named.items()])
        path = f"{self.root}/{table}/_log/{number}-{uuid.uuid4().hex[:8]}"
        writes.with_checksum(rows).write.parquet(path)
        self._note(table, number, path, "log", at)
        return number

    def replayed(self, table: str, after: int = -1, at: int | None = None, halt: bool = False) -> tuple[DataFrame, DataFrame]:
        """(vectors, edges) after the log; records with a bad checksum are passed over, or with halt fail the read."""
        log = writes.verified(self.log(table, after, at), halt)
        return writes.replay(last_changes(log)).select("vec.*"), writes.replay_edges(log)


def last_changes(log: DataFrame) -> DataFrame:
    """The upserts and deletes of a log, with the id that each is about."""
    return log.where("op in ('UPSERT', 'DELETE')").withColumn("id", F.coalesce("vec.id", "del_id"))
