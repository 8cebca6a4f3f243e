"""Similarity search blended with recency: one query, many queries, shards, over-fetch, age windows."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halflife.functions import temporal as t
from halflife.functions import vector as v
from halflife.functions.codec import payload_filter
from halflife.schema import DAY_MS, EngineError, SearchOptions, TemporalConfig

#: A query set of up to so many numbers is broadcast (64 MB); larger ones are dealt in blocks of that size, against blocks of so many rows.
BROADCAST_FLOATS = 8_000_000
BLOCK_ROWS = 125_000
#: Scores that a task makes at once (8 MB), numbers of a block of rows that it multiplies (16 MB), pairs that are scored one by one at once.
TILE_SCORES = 1_000_000
TILE_FLOATS = 2_000_000
PAIRS = 16_384
#: Rows that meet a broadcast query set are dealt to a task for each so many scores, and to so many tasks at most.
TASK_SCORES = 25_000_000
TASKS = 2_000


def live(vectors: DataFrame, at: int) -> DataFrame:
    """Rows that are valid at the time; a `deleted` column, if there is one, hides rows."""
    rows = vectors.where(t.is_valid_at(at))
    return rows.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in vectors.columns else rows


def scored(vectors: DataFrame, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), metric: str = "cosine") -> DataFrame:
    """The live, filtered rows with vector_score, temporal_score, score and the two staleness columns.

    The filters on plain columns stand below the scores, so Parquet sees them; the query is a literal.
    """
    share = config.blend if options.blend is None else options.blend
    rows = live(vectors, at)
    if "=" in options.filter:
        rows = rows.where(payload_filter(options.filter))
    weight = t.temporal_weight("created_at", at, config.half_life_ms)
    rows = rows.withColumn("temporal_score", weight).where(t.passes_cutoff(F.col("temporal_score"), config.cutoff))
    rows = rows.withColumn("vector_score", v.similarity("embedding", query, options.metric or metric, options.score_space))
    rows = rows.withColumn("score", t.blend(F.col("vector_score"), F.col("temporal_score"), share))
    stale = t.is_stale(F.col("temporal_score"), config) & F.lit(options.include_staleness)
    reason = F.when(F.lit(options.include_staleness), t.staleness_reason(F.col("temporal_score"), "created_at", at, config))
    return rows.withColumn("staleness_warning", stale).withColumn("staleness_reason", reason)


def ranked(rows: DataFrame, k: int, by: str = "score", key: str = "id") -> DataFrame:
    """The k best rows with their rank; ties by key. The window sees k rows."""
    best = rows.orderBy(F.desc(by), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))


def search(vectors: DataFrame, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), metric: str = "cosine") -> DataFrame:
    """The k best rows: rank, id, score, vector_score, temporal_score, payload, created_at and staleness.

    Partial heaps on the executors and one merge (TakeOrderedAndProject); the payload travels with k rows a
    partition only, as it is no part of the sort key.
    """
    columns = ["rank", "id", "score", "vector_score", "temporal_score", "payload", "created_at", "staleness_warning", "staleness_reason"]
    return ranked(scored(vectors, query, at, config, options, metric), options.top_k).select(*columns)


def search_one(vectors: DataFrame, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), metric: str = "cosine") -> DataFrame:
    return search(vectors, query, at, config, replace(options, top_k=1), metric)


def top_per_query(rows: DataFrame, k: int, by: str = "score", key: str = "id") -> DataFrame:
    """The k best rows of each query_id; the limit is pushed below the shuffle (WindowGroupLimit)."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Similarity:
    """How over_queries() scores rows (embedding, w) for queries: first by one matrix product, then the rows that may be among the best one by one.

    A product's last digits depend on where a row stands in it. What is decided on is added up dimension by dimension, so rows that are
    equal have equal scores and the smaller id goes first.
    """

    metric: str
    space: str
    share: float

    def prepare(self, block: pa.Table, dim: int) -> dict[str, np.ndarray]:
        return {"x": matrix_of(block.column("embedding"), dim), "w": block.column("w").to_numpy()}

    def about(self, q: np.ndarray, rows: dict) -> tuple[np.ndarray, float]:
        """The score of each query (rows) and row (columns), and how far it may be off."""
        x, w = rows["x"], rows["w"]
        score = similarities(q, x, self.metric, self.space)
        score *= 1 - self.share
        score += self.share * w[None]
        far = max(1.0, float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0))) * x.shape[1]
        return score, {"cosine": 1e-9, "l2": 1e-7 * far, "l2_squared": 1e-12 * far**2, "dot": 1e-12 * far**2}[self.metric]

    def exactly(self, q: np.ndarray, rows: dict, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
        """[score, vector_score, temporal_score] of pairs; the first decides."""
        sim, w = pair_similarities(q, rows["x"], row, col, self.metric, self.space), rows["w"][col]
        return [(1 - self.share) * sim + self.share * w, sim, w]


def pair_similarities(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, metric: str, space: str = "unit") -> np.ndarray:
    """The similarity of query row[i] to vector col[i], added up dimension by dimension."""
    out = np.zeros(len(row))
    for at in range(0, len(row), PAIRS):
        a, b = q[row[at : at + PAIRS]].T, x[col[at : at + PAIRS]].T
        dot, aa, bb, d = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1])
        for i in range(len(a)):
            if metric in ("l2", "l2_squared"):
                d += (a[i] - b[i]) ** 2
            else:
                dot += a[i] * b[i]
            if metric == "cosine":
                aa += a[i] * a[i]
                bb += b[i] * b[i]
        if metric == "dot":
            part = dot
        elif metric == "cosine":
            norms = np.sqrt(aa) * np.sqrt(bb)
            part = np.where(norms < v.TINY, 0.0, dot / np.maximum(norms, v.TINY))
            part = part if space == "raw" else (part + 1) / 2
        else:
            part = 1 / (1 + (d if metric == "l2_squared" else np.sqrt(d)))
        out[at : at + PAIRS] = part
    return out


class Best:
    """The k best rows of each query among the blocks that a task meets, ties by id: meet() gives k rows a query and block at most.

    Only the k-th best score so far is held, which the rows of later blocks must reach. Scores are made for TILE_SCORES pairs at once.
    """

    def __init__(self, ids: pa.Array, q: np.ndarray, k: int, method, names: list[str]):
        self.ids, self.q, self.k, self.method, self.names = ids, q, k, method, names
        self.floor = np.full(len(q), -np.inf)

    def meet(self, block: pa.Table):
        k, n_queries = self.k, len(self.q)
        if not k or not n_queries or not len(block):
            return
        order = pc.rank(block.column("id"), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        rows = self.method.prepare(block, self.q.shape[1])
        few = _k_of_equals(rows, order, k)
        if len(few) < len(block):
            block, order, rows = block.take(pa.array(few)), order[few], {c: x[few] for c, x in rows.items()}
        odd = any(np.isnan(x).any() for x in (self.q, *rows.values()))
        keys, step, held, n_held = block.column("id").combine_chunks(), max(1, TILE_SCORES // len(block)), [], 0
        for lo in range(0, n_queries, step):
            q, floor = self.q[lo : lo + step], self.floor[lo : lo + step]
            score, off = self.method.about(q, rows)
            if odd:
                score[np.isnan(score)] = np.inf  # as Spark orders it
            new = np.flatnonzero(np.isneginf(floor))
            least = floor.copy()
            if len(new) and score.shape[1] > k:
                least[new] = np.partition(score[new] if len(new) < len(q) else score, -k, axis=1)[:, -k]
            row, col = np.nonzero(score >= (least - off)[:, None])
            if not len(row):
                continue
            exact = self.method.exactly(q, rows, row, col)
            value = np.where(np.isnan(exact[0]), np.inf, exact[0])
            at = np.lexsort((order[col], -value, row))
            first = np.r_[True, row[at][1:] != row[at][:-1]]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            last = at[place == k - 1]
            floor[row[last]] = np.maximum(floor[row[last]], value[last])
            at = at[place < k]
            held.append(pa.RecordBatch.from_arrays([self.ids.take(pa.array(lo + row[at])), keys.take(pa.array(col[at])), *(pa.array(e[at]) for e in exact)], self.names))
            n_held += len(at)
            if n_held >= PAIRS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n_held = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _k_of_equals(rows: dict, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows but for those with k equal rows of smaller ids, which are no query's best."""
    if len(order) <= k:
        return np.arange(len(order))
    seen: dict[bytes, int] = {}
    body = np.ascontiguousarray(np.column_stack([x.reshape(len(order), -1) for x in rows.values()]).astype(float))
    group = np.fromiter((seen.setdefault(x.tobytes(), len(seen)) for x in body), np.int64, len(order))
    if len(seen) == len(order):
        return np.arange(len(order))
    at = np.lexsort((order, group))
    first = np.r_[True, group[at][1:] != group[at][:-1]]
    return np.sort(at[np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) < k])


def _blocks(batches):
    """Tables of TILE_FLOATS numbers or so, gathered from batches and cut out of large ones."""
    held, n = [], 0
    for b in batches:
        size = len(b.column("embedding").flatten()) if len(b) else 0
        step = max(1, len(b) * TILE_FLOATS // max(size, 1)) if size > TILE_FLOATS else max(1, len(b))
        for at in range(0, len(b), step):
            part = b.slice(at, step)
            held.append(part)
            n += size * len(part) // len(b)
            if n >= TILE_FLOATS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(q) -> np.ndarray:
    return matrix_of(q, len(q[0])) if len(q) else np.zeros((0, 0))


def over_queries(rows: DataFrame, queries: DataFrame, k: int, method, columns: list[str], lists: bool = False) -> DataFrame:
    """(query_id, id, *columns): at least the k best rows of every query (query_id, embedding), as method scores them; see Best.

    A query set of up to BROADCAST_FLOATS numbers travels to all batches. A larger one never meets the driver: queries and
    rows are dealt to blocks, each pair of blocks meets in one group, and a group holds its queries and streams its rows.
    With lists, queries have an array `lists` and meet only the rows whose column `cluster` is in it.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "cluster"]
    out = ["query_id", "id", *columns]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in columns)
    wanted = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"), *(["lists"] if lists else []))
    size = wanted.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    n_queries, floats, n_rows = size["n"] or 0, (size["n"] or 0) * (size["dim"] or 0), rows.count()
    tasks = min(TASKS, n_queries * n_rows // TASK_SCORES)
    if floats <= BROADCAST_FLOATS and not lists:
        table = wanted.toArrow()  # bounded: BROADCAST_FLOATS
        shared = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), _matrix(table.column("q"))))

        def run(batches):
            best = Best(*shared.value, k, method, out)
            for block in _blocks(batches):
                yield from best.meet(block)

        plain = rows.select(names)
        return (plain.repartition(int(tasks)) if tasks > 1 else plain).mapInArrow(run, schema)
    step = max(1, BROADCAST_FLOATS // max(1, size["dim"] or 1))
    row_blocks, query_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // step))
    cluster = F.col("cluster") if lists else F.lit(0)
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select(cluster.alias("c"), F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("r"), many(query_blocks).alias("k"), F.lit(1).alias("side"),
                        *names, F.lit(None).cast(wanted.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("array<double>").alias("q"))
    asked = wanted.select("*", F.explode("lists").alias("c")) if lists else wanted.withColumn("c", F.lit(0))
    asked = asked.select("c", many(row_blocks).alias("r"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("k"), F.lit(0).alias("side"),
                         *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "query_id", "q")

    def parts(batches):
        """(key, side, batch) for each run of rows of one group and side."""
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("c", "r", "k", "side")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if hi > lo:
                    yield tuple(key[lo, :3]), key[lo, 3], b.slice(lo, hi - lo)

    def meet(batches):
        for _, group in itertools.groupby(parts(batches), lambda part: part[0]):
            held, best = [], None
            for side, run in itertools.groupby(group, lambda part: part[1]):
                if side == 0:
                    held = [_queries_of(part) for _, _, part in run]
                    continue
                if held:
                    best, held = Best(pa.concat_arrays([i for i, _ in held]), np.concatenate([q for _, q in held]), k, method, out), []
                for block in _blocks(part.select(names) for _, _, part in run):
                    if best is not None:
                        yield from best.meet(block)

    key, both = ["c", "r", "k"], asked.unionAll(dealt.select(asked.columns))
    groups = row_blocks * query_blocks
    dealt_out = both.repartition(*key) if lists else both.repartitionById(groups, F.col("r") * query_blocks + F.col("k"))
    return dealt_out.sortWithinPartitions(*key, "side").mapInArrow(meet, schema)


def _queries_of(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    return part.column("query_id"), _matrix(part.column("q"))


def batch_similarities(vectors: DataFrame, queries: DataFrame, k: int, at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), metric: str = "cosine", lists: bool = False) -> DataFrame:
    """(query_id, rank, id, score, vector_score, temporal_score): many queries against all live rows.

    Each block of vectors is multiplied with the queries, a tile of them at a time, and keeps k rows of each query at most, so
    what is shuffled is k rows a query and block, whatever the table's size. queries has query_id and
    embedding, and its number is not bounded; see over_queries(), lists included.
    """
    share = config.blend if options.blend is None else options.blend
    rows = live(vectors, at)
    if "=" in options.filter:
        rows = rows.where(payload_filter(options.filter))
    weight = t.temporal_weight("created_at", at, config.half_life_ms)
    rows = rows.select("id", "embedding", weight.alias("w"), *(["cluster"] if lists else [])).where(t.passes_cutoff(F.col("w"), config.cutoff))
    columns = ["score", "vector_score", "temporal_score"]
    found = over_queries(rows, queries, k, Similarity(options.metric or metric, options.score_space, share), columns, lists)
    return top_per_query(found, k).select("query_id", "rank", "id", *columns)


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """(id, rank, neighbour, score): each row's k nearest other rows by raw cosine, exactly; rows meet in blocks."""
    plain = vectors.select("id", "embedding", F.lit(0).cast("long").alias("created_at"), F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_until"))
    options = SearchOptions(top_k=k + 1, blend=0.0, score_space="raw")
    near = batch_similarities(plain, plain.select(F.col("id").alias("query_id"), "embedding"), k + 1, 0, TemporalConfig(), options)
    others = near.where(F.col("query_id") != F.col("id")).drop("rank")
    return top_per_query(others, k).select(F.col("query_id").alias("id"), "rank", F.col("id").alias("neighbour"), "score")


def matrix_of(embedding: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    embedding = embedding.combine_chunks() if isinstance(embedding, pa.ChunkedArray) else embedding
    x = embedding.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) != len(embedding) * dim or pc.count_distinct(pc.list_value_length(embedding)).as_py() > 1:
        raise EngineError("a vector's dimension differs from the queries'")
    return x.reshape(len(embedding), -1)


def similarities(q: np.ndarray, x: np.ndarray, metric: str, space: str = "unit") -> np.ndarray:
    """The similarity of each query (rows) to each vector (columns)."""
    if metric == "dot":
        return q @ x.T
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    if metric in ("l2", "l2_squared"):
        d = np.maximum(qn[:, None] ** 2 + xn[None] ** 2 - 2 * (q @ x.T), 0)
        return 1 / (1 + (d if metric == "l2_squared" else np.sqrt(d)))
    if qn.min(initial=np.inf) * xn.min(initial=np.inf) >= v.TINY:
        c = (q / qn[:, None]) @ (x / xn[:, None]).T
        return c if space == "raw" else (c + 1) / 2
    norms = qn[:, None] * xn[None]
    c = np.where(norms < v.TINY, 0.0, (q @ x.T) / np.maximum(norms, v.TINY))
    return c if space == "raw" else (c + 1) / 2


def batch_search(vectors: DataFrame, queries: DataFrame, at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), metric: str = "cosine") -> DataFrame:
    return batch_similarities(vectors, queries, options.top_k, at, config, options, metric)


def distances(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows by plain distance: 1 - cos, or squared L2; (rank, id, distance)."""
    d = 1 - v.cosine("embedding", query) if metric == "cosine" else v.l2_squared("embedding", query)
    best = vectors.select("id", d.alias("distance")).orderBy("distance", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("rank", "id", "distance")


def overfetch_search(vectors: DataFrame, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), overfetch: int = 4) -> DataFrame:
    """Two stages: the overfetch * k nearest by raw cosine, then the predicates and the blend on those alone."""
    pool = vectors.orderBy(F.desc(v.cosine("embedding", query)), "id").limit(overfetch * options.top_k)
    return search(pool, query, at, config, replace(options, score_space="raw"))


def shard_search(vectors: DataFrame, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), shard: Column | str = "shard") -> DataFrame:
    """Each shard's 2 k best, then the k best of all: what one search gives, with the shard named."""
    rows = scored(vectors.withColumn("shard", F.col(shard) if isinstance(shard, str) else shard), query, at, config, options)
    order = Window.partitionBy("shard").orderBy(F.desc("score"), "id")
    each = rows.withColumn("in_shard", F.row_number().over(order)).where(F.col("in_shard") <= 2 * options.top_k)
    return ranked(each, options.top_k).select("rank", "id", "shard", "score", "vector_score", "temporal_score")


def age_window_search(vectors: DataFrame, query: Sequence[float], at: int, days: int, k: int) -> DataFrame:
    """Cosine alone over rows of at most so many days."""
    rows = vectors.where(t.age_days("created_at", at) <= days)
    return ranked(rows.withColumn("score", v.cosine("embedding", query)), k).select("rank", "id", "score")


def cosine_search(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    return ranked(vectors.withColumn("score", v.cosine("embedding", query)), k).select("rank", "id", "score")


def point(vectors: DataFrame, id_value) -> DataFrame:
    """The row of an id; the equality reaches the Parquet reader."""
    return vectors.where(F.col("id") == id_value)


def choose_strategy(n_rows: int, recall: float = 1.0, dim: int = 768) -> str:
    """exact unless a lower recall is accepted and the table is large: then inverted lists, and codes beyond a terabyte."""
    if recall >= 0.999 or n_rows < 1_000_000:
        return "exact"
    return "pq" if n_rows * dim * 4 > 1 << 40 else "ivf"


def days(n: int) -> int:
    return n * DAY_MS
