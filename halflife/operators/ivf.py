"""Inverted lists: centroids from a bounded sample, every row assigned, the nearest lists searched exactly."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.functions import vector as v
from halflife.operators.quantize import SAMPLE_ROWS, k_means, sample_matrix
from halflife.operators.search import batch_similarities, search
from halflife.schema import SearchOptions, TemporalConfig

#: A list's rows are dealt over so many tasks where they are written.
SALTS = 8
#: Rows that serve as queries where the number of lists to probe is measured.
SAMPLE_QUERIES = 200


def train(vectors: DataFrame, n_lists: int, rounds: int = 20, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    return k_means(sample_matrix(vectors, sample_rows), n_lists, rounds)


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with a column cluster: the nearest centre. Write it partitioned by cluster to prune by list."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(e: pa.Array) -> pa.Array:
        x = e.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(e), -1)
        c = shared.value
        return pa.array((((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1) if len(e) else np.zeros(0)).astype(np.int32))

    return vectors.withColumn("cluster", F.arrow_udf(run, "int")(F.col("embedding")))


def nearest_lists(centres: np.ndarray, query: Sequence[float], n_probe: int) -> list[int]:
    d = ((centres - np.asarray(query, float)) ** 2).sum(axis=1)
    return [int(i) for i in np.lexsort((np.arange(len(d)), d))[:n_probe]]


def probe(assigned: DataFrame, centres: np.ndarray, query: Sequence[float], n_probe: int) -> DataFrame:
    """The rows of the nearest lists: a literal IN on the partition column, which prunes files."""
    return assigned.where(F.col("cluster").isin(nearest_lists(centres, query, n_probe)))


def ivf_search(assigned: DataFrame, centres: np.ndarray, query: Sequence[float], n_probe: int, at: int, config: TemporalConfig, options: SearchOptions = SearchOptions()) -> DataFrame:
    return search(probe(assigned, centres, query, n_probe), query, at, config, options)


def batch_ivf_search(assigned: DataFrame, centres: np.ndarray, queries: DataFrame, n_probe: int, at: int, config: TemporalConfig, options: SearchOptions = SearchOptions()) -> DataFrame:
    """ivf_search for many queries (query_id, embedding): each meets the rows of the lists that it probes."""
    lists = F.arrow_udf(lambda e: pa.array([nearest_lists(centres, x, n_probe) for x in e.to_pylist()], pa.list_(pa.int32())), "array<int>")
    return batch_similarities(assigned, queries.withColumn("lists", lists(F.col("embedding"))), options.top_k, at, config, options, lists=True)


@dataclass(frozen=True)
class Stored:
    """Inverted lists in a folder: rows partitioned by cluster, beside their centres."""

    path: str
    centres: np.ndarray
    #: Lists that a search probes unless told otherwise: see probes_for().
    n_probe: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def store(vectors: DataFrame, path: str, n_lists: int, sample_rows: int = SAMPLE_ROWS) -> Stored:
    """Every row, written once under its list, so a search reads the files of the lists it probes. Centres come from a bounded sample.

    A list's rows are dealt over SALTS tasks, so a list that holds much of the table is no task of its own.
    """
    spark, centres = vectors.sparkSession, train(vectors, n_lists, sample_rows=sample_rows)
    assign(vectors, centres).repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(SALTS))).write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/lists")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return Stored(path, centres, len(centres))


def save_probes(spark: SparkSession, lists: Stored, n_probe: int) -> Stored:
    spark.createDataFrame([(n_probe,)], "n_probe int").coalesce(1).write.mode("overwrite").parquet(f"{lists.path}/probes")
    return replace(lists, n_probe=n_probe)


def load(spark: SparkSession, path: str) -> Stored:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()  # n_lists rows
    return Stored(path, np.array([r["centre"] for r in rows], float), spark.read.parquet(f"{path}/probes").first()["n_probe"])


def sample_queries(vectors: DataFrame, n: int = SAMPLE_QUERIES) -> DataFrame:
    """(query_id, embedding) of the n rows with the smallest hashes."""
    return vectors.select(F.col("id").alias("query_id"), "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(n)


def probes_for(lists: Stored, vectors: DataFrame, queries: DataFrame, recall: float, at: int, config: TemporalConfig, metric: str = "cosine", k: int = 10) -> int:
    """The fewest lists a query that hold this mean share of the k best rows, as the exact search finds them among all rows."""
    truth = batch_similarities(vectors, queries, k, at, config, SearchOptions(top_k=k), metric).select("query_id", "id")
    place = F.arrow_udf(lambda e: pa.array([nearest_lists(lists.centres, x, len(lists.centres)) for x in e.to_pylist()], pa.list_(pa.int32())), "array<int>")
    held = lists.rows(vectors.sparkSession).select("id", "cluster").join(truth, "id").join(queries.withColumn("order", place(F.col("embedding"))).select("query_id", "order"), "query_id")
    found = held.groupBy(F.array_position("order", F.col("cluster")).alias("at")).agg(F.count("*").alias("n")).collect()  # a row for each list
    counts = np.zeros(len(lists.centres) + 1)
    for r in found:
        counts[r["at"]] = r["n"]
    share = counts.cumsum() / max(1, counts.sum())
    return max(1, int(np.searchsorted(share, recall)))


def ivf_distances(assigned: DataFrame, centres: np.ndarray, query: Sequence[float], n_probe: int, k: int) -> DataFrame:
    """(id, distance): squared L2 within the nearest lists."""
    rows = probe(assigned, centres, query, n_probe)
    return rows.select("id", v.l2_squared("embedding", query).alias("distance")).orderBy("distance", "id").limit(k)


def centroid_update(assigned: DataFrame) -> DataFrame:
    """(cluster, place, mean): one step of Lloyd's algorithm over all rows, in long form."""
    long = assigned.select("cluster", F.posexplode("embedding").alias("place", "x"))
    return long.groupBy("cluster", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
