"""Product quantization: codebooks, codes, table distances, approximate search with exact rescoring."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.functions import temporal as t
from halflife.functions import vector as v
from halflife.functions.codec import payload_filter
from halflife.operators.search import Similarity, batch_similarities, live, matrix_of, over_queries, ranked, top_per_query
from halflife.schema import EngineError, SearchOptions, TemporalConfig
from halflife.sources.scratch import stored

#: Codebooks are fitted on so many rows at most, those with the smallest hashes; every row gets a code.
SAMPLE_ROWS = 50_000
#: Rows whose distances to all centres are made at once.
PIECE = 4_096
#: Rows that a task encodes where codes are stored.
TASK_ROWS = 25_000
#: Centroids of a part at most.
MOST_CENTROIDS = 16_384


def _pieces(x: np.ndarray) -> list[np.ndarray]:
    return [x[at : at + PIECE] for at in range(0, max(1, len(x)), PIECE)]


def k_means(x: np.ndarray, k: int, rounds: int = 25, seed: int = 42) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; an emptied cluster keeps its centre."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        size = (centres * centres).sum(1)[None]
        near = np.concatenate([((p * p).sum(1)[:, None] - 2 * p @ centres.T + size).argmin(1) for p in _pieces(x)])
        sums, n = np.stack([np.bincount(near, weights=part, minlength=k) for part in x.T], axis=1), np.bincount(near, minlength=k)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def sample_matrix(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most so many embeddings on the driver, chosen by the hash of their id."""
    picked = vectors.select("id", F.col("embedding").cast("array<double>").alias("e")).orderBy(F.xxhash64("id"), "id").limit(rows)
    return np.array(picked.toArrow().column("e").to_pylist(), float)


@dataclass(frozen=True)
class Codebook:
    """centres has the shape (subspaces, centroids, width)."""

    centres: np.ndarray

    @property
    def subspaces(self) -> int:
        return self.centres.shape[0]

    def table(self, query: Sequence[float]) -> np.ndarray:
        """Squared distances from each part of the query to each centre."""
        q = np.asarray(query, float).reshape(self.subspaces, 1, -1)
        return ((self.centres - q) ** 2).sum(axis=2)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each part, the lowest number of equals."""
        return np.concatenate([self._encode(p) for p in _pieces(x)])

    def _encode(self, x: np.ndarray) -> np.ndarray:
        parts, out = x.reshape(len(x), self.subspaces, -1), np.empty((len(x), self.subspaces), np.int64)
        for m, centre in enumerate(self.centres):
            d = np.zeros((len(x), len(centre)))
            for i in range(centre.shape[1]):
                d += (parts[:, m, i, None] - centre[None, :, i]) ** 2
            out[:, m] = d.argmin(1)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(m, c, [float(x) for x in self.centres[m, c]]) for m in range(self.subspaces) for c in range(self.centres.shape[1])]
        spark.createDataFrame(rows, "m int, c int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Codebook:
        rows = spark.read.parquet(path).orderBy("m", "c").collect()  # subspaces * 256 rows
        m = 1 + max(r["m"] for r in rows)
        return Codebook(np.array([r["centre"] for r in rows], float).reshape(m, -1, len(rows[0]["centre"])))


def train(vectors: DataFrame, subspaces: int, centroids: int = 256, rounds: int = 25, sample_rows: int = SAMPLE_ROWS) -> Codebook:
    x = sample_matrix(vectors, sample_rows)
    if not len(x):
        raise EngineError("a codebook needs at least one vector")
    if x.shape[1] % subspaces:
        raise EngineError(f"{subspaces} subspaces do not divide dimension {x.shape[1]}")
    sc = vectors.sparkSession.sparkContext
    shared = sc.broadcast(x.reshape(len(x), subspaces, -1))  # sample_rows rows; the parts are fitted by a task each
    return Codebook(np.stack(sc.parallelize(range(subspaces), subspaces).map(lambda m: k_means(np.ascontiguousarray(shared.value[:, m]), centroids, rounds)).collect()))


def store(vectors: DataFrame, queries: DataFrame, path: str, subspaces: int, centroids: int, recall: float, at: int, config: TemporalConfig, k: int = 10) -> tuple[Codebook, str]:
    """The codebook, and the folder of vectors with their codes: the fewest codes from these on that find this mean share of the k best rows of queries.

    The denser a table, the finer its codes must be. What the exact search with the similarity that codes approximate finds is
    made once; subspaces are doubled as far as the dimension lets, then a part gets four times the centroids.
    """
    spark, dim = vectors.sparkSession, vectors.select(F.max(F.size("embedding"))).first()[0]
    rows = vectors.repartition(max(1, vectors.count() // TASK_ROWS), "id")
    truth = stored(batch_similarities(vectors, queries, k, at, config, SearchOptions(top_k=k), "l2_squared").select("query_id", "id"), "truth")
    for n in itertools.count():
        book, out = train(vectors, subspaces, centroids), f"{path}/{n}"
        encode(rows, book).write.parquet(out)
        found = batch_pq_search(spark.read.parquet(out), book, queries, at, config, SearchOptions(top_k=k))
        hits, wanted = found.select("query_id", "id").join(truth, ["query_id", "id"]).count(), truth.count()
        if hits >= recall * wanted or (subspaces == dim and centroids >= MOST_CENTROIDS):
            return book, out
        if dim % (2 * subspaces) == 0:
            subspaces *= 2
        else:
            subspaces, centroids = (dim, centroids) if subspaces < dim else (dim, 4 * centroids)


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    """vectors with a column code (array<smallint>), one Arrow batch at a time."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)  # subspaces * 256 centres

    def run(e: pa.Array) -> pa.Array:
        x = e.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(e), -1)
        codes = shared.value.encode(x).astype(np.int16) if len(e) else np.zeros((0, 1), np.int16)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel()))

    return vectors.withColumn("code", F.arrow_udf(run, "array<smallint>")(F.col("embedding")))


def decode(code: Column | str, book: Codebook) -> Column:
    centres = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m]) for m in book.centres])
    code = F.col(code) if isinstance(code, str) else code
    return F.flatten(F.zip_with(code, centres, lambda c, m: F.get(m, c.cast("int"))))


def adc(code: Column | str, book: Codebook, query: Sequence[float]) -> Column:
    """The squared distance of the query to a code, by table look-up."""
    table = book.table(query)
    code = F.col(code) if isinstance(code, str) else code
    terms = [F.get(F.array(*[F.lit(float(x)) for x in row]), F.get(code, m).cast("int")) for m, row in enumerate(table)]
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return out


def adc_scores(coded: DataFrame, book: Codebook, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions()) -> DataFrame:
    share = config.blend if options.blend is None else options.blend
    rows = live(coded, at)
    if "=" in options.filter:
        rows = rows.where(payload_filter(options.filter))
    rows = rows.withColumn("temporal_score", t.temporal_weight("created_at", at, config.half_life_ms)).where(t.passes_cutoff(F.col("temporal_score"), config.cutoff))
    rows = rows.withColumn("vector_score", v.adc_similarity(adc("code", book, query)))
    return rows.withColumn("score", t.blend(F.col("vector_score"), F.col("temporal_score"), share))


def pq_pool(coded: DataFrame, book: Codebook, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), factor: int = 4) -> DataFrame:
    """The factor * k best rows by codes."""
    return adc_scores(coded, book, query, at, config, options).orderBy(F.desc("score"), "id").limit(factor * options.top_k)


def pq_search(coded: DataFrame, book: Codebook, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The k best rows by codes alone; approximate is true for each."""
    best = ranked(adc_scores(coded, book, query, at, config, options), options.top_k)
    return best.select("rank", "id", "score", "vector_score", "temporal_score", F.lit(True).alias("approximate"))


def pq_rescored(coded: DataFrame, book: Codebook, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), factor: int = 4) -> DataFrame:
    """The factor * k best by codes, scored again with their vectors and sorted again."""
    pool = pq_pool(coded, book, query, at, config, options, factor)
    share = config.blend if options.blend is None else options.blend
    exact = pool.withColumn("vector_score", v.similarity("embedding", query, options.metric or "cosine", options.score_space))
    exact = exact.withColumn("score", t.blend(F.col("vector_score"), F.col("temporal_score"), share))
    return ranked(exact, options.top_k).select("rank", "id", "score", "vector_score", "temporal_score", F.lit(False).alias("approximate"))


@dataclass(frozen=True)
class ByCode(Similarity):
    """Rows (embedding, code, w) by the distance of a query to their codes; the score of their vectors goes along."""

    book: Codebook

    def prepare(self, block: pa.Table, dim: int) -> dict[str, np.ndarray]:
        return super().prepare(block, dim) | {"code": matrix_of(block.column("code"), self.book.subspaces).astype(np.int64)}

    def _by_code(self, near: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (1 - self.share) * near + self.share * w

    def about(self, q: np.ndarray, rows: dict) -> tuple[np.ndarray, float]:
        out = np.empty((len(q), len(rows["w"])))
        for i, x in enumerate(q):
            table, d = self.book.table(x), np.zeros(out.shape[1])
            for m in range(self.book.subspaces):
                d += table[m].take(rows["code"][:, m])
            out[i] = self._by_code(1 / (1 + d), rows["w"])
        return out, 0.0

    def exactly(self, q: np.ndarray, rows: dict, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        d, starts = np.zeros(len(row)), np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(row)], strict=True):
            table, codes = self.book.table(q[row[lo]]), rows["code"][col[lo:hi]]
            for m in range(self.book.subspaces):
                d[lo:hi] += table[m].take(codes[:, m])
        near = 1 / (1 + d)
        return [self._by_code(near, rows["w"][col]), near, *super().exactly(q, rows, row, col)]


def batch_pq_search(coded: DataFrame, book: Codebook, queries: DataFrame, at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), factor: int = 0) -> DataFrame:
    """pq_search, or with a factor pq_rescored, for many queries (query_id, embedding): (query_id, rank, id, score, vector_score, temporal_score, approximate)."""
    share = config.blend if options.blend is None else options.blend
    rows = live(coded, at)
    if "=" in options.filter:
        rows = rows.where(payload_filter(options.filter))
    rows = rows.select("id", "embedding", "code", t.temporal_weight("created_at", at, config.half_life_ms).alias("w")).where(t.passes_cutoff(F.col("w"), config.cutoff))
    pool = max(1, factor) * options.top_k
    method = ByCode(options.metric or "cosine", options.score_space, share, book)
    found = top_per_query(over_queries(rows, queries, pool, method, ["by_code", "near", "score", "vector_score", "temporal_score"]), pool, "by_code").drop("rank")
    if factor:
        return top_per_query(found, options.top_k).select("query_id", "rank", "id", "score", "vector_score", "temporal_score", F.lit(False).alias("approximate"))
    return top_per_query(found, options.top_k, "by_code").select("query_id", "rank", "id", F.col("by_code").alias("score"), F.col("near").alias("vector_score"), "temporal_score", F.lit(True).alias("approximate"))
