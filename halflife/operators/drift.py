"""Moving a collection to another embedding model: a new table version, with progress as counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.schema import EngineError

PHASES = ("IDLE", "MIGRATING", "SWAPPING", "COMPLETE", "FAILED")


def migrate(vectors: DataFrame, new_embeddings: DataFrame, version: int = 1) -> DataFrame:
    """All rows, with the new embedding where new_embeddings (id, embedding) has a non-empty one.

    Rows without one are kept in the old space and say so: migrated is false, model_version one less.
    """
    new = new_embeddings.where(F.size("embedding") > 0).select("id", F.col("embedding").alias("_new")).dropDuplicates(["id"])
    out = vectors.drop("migrated", "model_version").join(new, "id", "left")
    done = F.col("_new").isNotNull()
    return out.withColumn("embedding", F.coalesce("_new", "embedding")).withColumn("migrated", done).withColumn("model_version", F.when(done, version).otherwise(version - 1)).drop("_new")


def re_embed(vectors: DataFrame, function, version: int = 1) -> DataFrame:
    """migrate() with the embeddings of an Arrow UDF over (id, payload)."""
    return migrate(vectors, vectors.select("id", function(F.col("id"), F.col("payload")).alias("embedding")), version)


def progress(migrated: DataFrame) -> DataFrame:
    """One row: phase, total, migrated, skipped and pct = 100 (migrated + skipped) / total, 0 of nothing."""
    done = F.count_if("migrated")
    return migrated.agg(F.count("*").alias("total"), done.alias("migrated"), (F.count("*") - done).alias("skipped")).select(
        F.lit("COMPLETE").alias("phase"), "total", "migrated", "skipped",
        F.when(F.col("total") == 0, 0.0).otherwise(100.0 * (F.col("migrated") + F.col("skipped")) / F.greatest("total", F.lit(1))).alias("pct"))


class Migration:
    """One run of a migration: IDLE, MIGRATING while re-embedded batches arrive, SWAPPING, then COMPLETE; or FAILED by abort().

    Batches are appended to a shadow folder, so a run that is started anew goes on where it was; rows of the collection
    that came after the start are in the shadow as soon as a batch brings them.
    """

    def __init__(self, vectors: DataFrame, path: str, version: int = 1):
        self.vectors, self.path, self.version, self.phase = vectors, path, version, "IDLE"

    def _expect(self, *phases: str) -> None:
        if self.phase not in phases:
            raise EngineError(f"the migration is {self.phase}")

    def start(self) -> None:
        self._expect("IDLE")
        self.phase = "MIGRATING"
        empty = self.vectors.select("id", "embedding").limit(0)
        empty.write.mode("append").parquet(self.path)

    def shadow(self) -> DataFrame:
        return self.vectors.sparkSession.read.parquet(self.path).dropDuplicates(["id"])

    def add(self, batch: DataFrame, number: int | None = None) -> None:
        """Re-embedded rows (id, embedding); the shape of foreachBatch."""
        self._expect("MIGRATING")
        batch.select("id", "embedding").write.mode("append").parquet(self.path)

    def finish(self) -> DataFrame:
        """All rows, with the new embeddings where there are any; the caller writes them as the new version."""
        self._expect("MIGRATING")
        self.phase = "SWAPPING"
        moved = migrate(self.vectors, self.shadow(), self.version)
        self.phase = "COMPLETE"
        return moved

    def abort(self) -> None:
        self._expect("IDLE", "MIGRATING")
        self.phase = "FAILED"

    def status(self) -> DataFrame:
        """One row: phase, total, migrated, skipped and pct. Nothing is counted before the start, and nothing as migrated after an abort."""
        if self.phase in ("IDLE", "FAILED"):
            total = F.lit(0).cast("long") if self.phase == "IDLE" else F.count("*")
            return self.vectors.agg(total.alias("total")).select(F.lit(self.phase).alias("phase"), "total", F.lit(0).cast("long").alias("migrated"), F.lit(0).cast("long").alias("skipped"), F.lit(0.0).alias("pct"))
        now = progress(migrate(self.vectors, self.shadow(), self.version))
        if self.phase == "COMPLETE":
            return now
        share = F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("migrated") / F.greatest("total", F.lit(1)))
        return now.select(F.lit(self.phase).alias("phase"), "total", "migrated", F.lit(0).cast("long").alias("skipped"), share.alias("pct"))


def dual_write(batch: DataFrame, tables: list[str]) -> None:
    """A micro-batch appended to several tables: the shadow writes of a running migration, for foreachBatch."""
    batch.persist()
    for path in tables:
        batch.write.mode("append").parquet(path)
    batch.unpersist()


def procrustes(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The orthogonal matrix that turns old rows onto new rows with the least squared error (by SVD)."""
    if old.shape != new.shape or not len(old):
        raise EngineError("paired rows of equal shape are needed")
    u, _, vt = np.linalg.svd(old.T @ new)
    return u @ vt
