"""Writes as table transformations: upserts, deletes, time to live, dedup on write, change-log replay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflife.functions import temporal as t
from halflife.functions import vector as v
from halflife.operators.quantize import k_means, sample_matrix
from halflife.operators.search import matrix_of
from halflife.schema import AgentConfig
from halflife.sources.scratch import stored

#: Rows of a block of near_pairs() and numbers of its vectors at most: what is shuffled is each row once a block. Rows of a cluster, and clusters at most.
BLOCK = 32_768
BLOCK_FLOATS = 2_000_000
CLUSTER = 2_048
CENTRES = 256
#: Scores that are made at once (8 MB). Clusters go unused where a row of a sample has to visit more than this share of them.
TILE_SCORES = 1_000_000
VISITED = 0.5


def with_defaults(rows: DataFrame, now: Column | int) -> DataFrame:
    """created_at defaults to now, valid_from to created_at; ttl_seconds, if there, sets valid_until from created_at."""
    now = now if isinstance(now, Column) else F.lit(int(now)).cast("long")
    out = rows.withColumn("created_at", F.coalesce("created_at", now) if "created_at" in rows.columns else now)
    out = out.withColumn("valid_from", F.coalesce("valid_from", "created_at") if "valid_from" in rows.columns else F.col("created_at"))
    until = F.col("valid_until") if "valid_until" in rows.columns else F.lit(None).cast("long")
    if "ttl_seconds" in rows.columns:
        until = F.coalesce(t.with_ttl("created_at", F.col("ttl_seconds")), until)
    return out.withColumn("valid_until", until).drop("ttl_seconds")


def checked_dim(rows: DataFrame, dim: int) -> DataFrame:
    """rows; one without embedding or of another dimension fails the write."""
    bad = F.coalesce(F.size("embedding") != dim, F.lit(True))
    return rows.withColumn("embedding", F.when(bad, F.raise_error(F.concat(F.lit(f"dimension {dim} expected at "), F.col("id").cast("string")))).otherwise(F.col("embedding")))


def apply_agent(rows: DataFrame, agent: AgentConfig) -> DataFrame:
    """An enabled agent's time to live overrides the rows' own."""
    if not agent.enabled or agent.ttl_seconds <= 0:
        return rows
    return rows.withColumn("valid_until", t.with_ttl("created_at", agent.ttl_seconds))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the row with the largest order; combined before the shuffle, no sort of whole rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(rows.columns)


def upsert(table: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """table with the rows of new added, or in place of rows of the same id. Within new the last by order wins."""
    new = last_wins(new, "id", order) if order else new.dropDuplicates(["id"])
    return table.join(new.select("id"), "id", "left_anti").unionByName(new.select(*[c for c in new.columns if c in table.columns]), allowMissingColumns=True).select(table.columns)


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def deleted_count(table: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many ids of the list exist."""
    return table.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("n_deleted"))


def purge_expired(table: DataFrame, at: int) -> DataFrame:
    return table.where(F.coalesce(F.col("valid_until") >= F.lit(at), F.lit(True)))


def set_ttl(table: DataFrame, seconds: Column | int) -> DataFrame:
    return table.withColumn("valid_until", t.with_ttl("created_at", seconds))


def _unit(embedding: pa.Array, dim: int) -> np.ndarray:
    x = matrix_of(embedding, dim)
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n < v.TINY, 1.0, n)[:, None]


def _clustered(vectors: DataFrame, n: int, reach: float) -> tuple[DataFrame, np.ndarray]:
    """vectors with cluster, the nearest of about n / CLUSTER unit centres, and gap, the distance to it; and the centres. One cluster where more rule nothing out."""
    centres = np.zeros((1, 0))
    rows = min(BLOCK, CLUSTER)
    if n > rows:
        x = sample_matrix(vectors)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1)), v.TINY)[:, None]
        centres = k_means(x, min(CENTRES, -(-n // rows)), 10)
        d = _distances(x[:1_000], centres)
        far = np.full(len(centres), -np.inf)
        np.maximum.at(far, d.argmin(axis=1), d.min(axis=1))
        if (d <= far[None] + reach).mean() > VISITED:
            centres = np.zeros((1, 0))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # CENTRES rows at most

    def run(e: pa.Array) -> pa.Array:
        c, d = np.zeros(len(e), np.int32), np.zeros(len(e))
        if len(e) and shared.value.shape[1]:
            d = _distances(_unit(e, shared.value.shape[1]), shared.value)
            c, d = d.argmin(axis=1).astype(np.int32), d.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(c), pa.array(d)], ["cluster", "gap"])

    return vectors.withColumn("_at", F.arrow_udf(run, "struct<cluster: int, gap: double>")(F.col("embedding"))).select("*", "_at.*").drop("_at"), centres


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0))


def _near(vectors: DataFrame, threshold: float, probes: Column | None, schema: str, out) -> DataFrame:
    """out(ids of the probes, ids of the earlier rows, scores) of every block of rows that meet; see near_pairs()."""
    rows = vectors.select("id", "created_at", "embedding", (F.lit(True) if probes is None else probes).alias("probe"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    # Unit vectors of that similarity are no farther apart than this; the zero vector has similarity 0.5 to all.
    reach = (4.0 * (1.0 - threshold)) ** 0.5 + 1e-9 if threshold > 0.5 else float("inf")
    block = max(1, min(BLOCK, BLOCK_FLOATS // max(1, size["dim"] or 1)))
    dealt, centres = _clustered(rows, size["n"], reach)
    dealt = stored(dealt, "clustered")
    sizes = {r["cluster"]: (r["n"], r["gap"]) for r in dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect()}  # CENTRES rows
    far = np.array([sizes.get(c, (0, -np.inf))[1] for c in range(len(centres))]) + reach
    member_blocks = {c: -(-k // block) for c, (k, _) in sizes.items()}
    shared = vectors.sparkSession.sparkContext.broadcast((centres, far))

    def visited(e: pa.Array) -> pa.Array:
        centres, far = shared.value
        if not centres.shape[1]:
            return pa.array([[0]] * len(e), pa.list_(pa.int32()))
        hit = _distances(_unit(e, centres.shape[1]), centres) <= far[None] if len(e) else []
        return pa.array([np.flatnonzero(h).astype(np.int32) for h in hit], pa.list_(pa.int32()))

    columns = ["id", "created_at", "embedding"]
    probing = dealt.where("probe").select(*columns, F.explode(F.arrow_udf(visited, "array<int>")(F.col("embedding"))).alias("cluster"))
    probe_blocks = {r["cluster"]: -(-r["n"] // block) for r in probing.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    count = lambda held: F.coalesce(F.get(F.array(*[F.lit(max(1, held.get(c, 1))) for c in range(len(centres))]), F.col("cluster")), F.lit(1))
    own = lambda held: F.pmod(F.xxhash64("id"), count(held)).cast("int")
    every = lambda held: F.explode(F.sequence(F.lit(0), count(held) - 1))
    left = probing.select(*columns, "cluster", own(probe_blocks).alias("i"), every(member_blocks).alias("j"), F.lit(0).alias("side"))
    right = dealt.select(*columns, "cluster", every(probe_blocks).alias("i"), own(member_blocks).alias("j"), F.lit(1).alias("side"))

    def groups(batches):
        held, now = [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("cluster", "i", "j")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if held and now != tuple(key[lo]):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = tuple(key[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for g in groups(b for b in batches if len(b)):
            side = g.column("side").to_numpy()
            p, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(p) or not len(m):
                continue
            ids, made = g.column("id").to_pylist(), g.column("created_at").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (made[i] is not None, made[i], ids[i]) if made[i] is not None else (False, 0, ids[i]))
            rank, last = np.zeros(len(ids), np.int64), None
            for n, i in enumerate(order):  # a row on both sides has one rank
                same = last is not None and ids[i] == ids[last] and made[i] == made[last]
                rank[i], last = rank[last] if same else n, i
            e = g.column("embedding").chunk(0)
            x = _unit(e, len(e.flatten()) // len(e))
            members, step = np.ascontiguousarray(x[m].T), max(1, TILE_SCORES // len(m))
            for at in range(0, len(p), step):
                some = p[at : at + step]
                score = (x[some] @ members + 1) / 2
                score[rank[m][None] >= rank[some][:, None]] = -1
                row, col = np.nonzero(score >= threshold)
                if len(row):
                    yield out(g.column("id").chunk(0), some[row], m[col], score[row, col])

    return left.unionAll(right).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side").mapInArrow(run, schema)


def near_pairs(vectors: DataFrame, threshold: float, probes: Column | None = None) -> DataFrame:
    """(a, b, score) of rows whose unit-space cosine reaches the threshold; a is the earlier row by (created_at, id). With probes, b is one of the rows it marks.

    Exact, by matrix products of blocks of BLOCK rows at most, a tile of scores at a time. Rows lie in the cluster of their nearest centre; a row meets the
    blocks of every cluster that the triangle inequality does not rule out: those whose centre is no farther than the
    cluster's own reach plus the distance that the threshold allows. High thresholds on clustered vectors so leave few
    blocks; a low one, or vectors without structure, leave all, which is the cost of all products. created_at may be null (earliest).
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def out(ids, b, a, score):
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], ["a", "b", "score"])

    return _near(vectors, threshold, probes, f"a {kind}, b {kind}, score double", out)


def later_rows(vectors: DataFrame, threshold: float, probes: Column | None = None) -> DataFrame:
    """(id) of rows (of the probes) that have an earlier row as similar as the threshold; a block reports a row once, however many copies it meets."""
    def out(ids, b, a, score):
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.unique(b)))], ["id"])

    return _near(vectors, threshold, probes, f"id {vectors.schema['id'].dataType.simpleString()}", out).distinct()


def dedup(vectors: DataFrame, threshold: float) -> DataFrame:
    """Rows without an earlier row as similar as the threshold."""
    return vectors.join(later_rows(vectors, threshold), "id", "left_anti")


def replay(changes: DataFrame) -> DataFrame:
    """The live rows after a change log (lsn, op, id and further columns): the last change of each id, unless a DELETE."""
    return last_wins(changes, "id", "lsn").where("op = 'UPSERT'")


def replay_edges(changes: DataFrame) -> DataFrame:
    """All edges that the log added, in order; edges of ids that a later DELETE removed are gone."""
    added = changes.where("op = 'ADD_EDGE'").select("lsn", "edge.*")
    gone = changes.where("op = 'DELETE'").groupBy(F.col("del_id").alias("id")).agg(F.max("lsn").alias("at"))
    for end in ("src", "tgt"):
        added = added.join(gone, (F.col(end) == F.col("id")) & (F.col("at") > F.col("lsn")), "left_anti")
    return added.drop("lsn")


def truncate_before(changes: DataFrame, lsn: int) -> DataFrame:
    return changes.where(F.col("lsn") >= lsn)


def with_checksum(changes: DataFrame) -> DataFrame:
    return changes.withColumn("crc", F.crc32(F.to_json(F.struct(*changes.columns)).cast("binary")))


def verified(changes: DataFrame, halt: bool = False) -> DataFrame:
    """Records whose checksum holds, from with_checksum(); with halt a broken one fails the read."""
    body = [c for c in changes.columns if c != "crc"]
    good = F.crc32(F.to_json(F.struct(*body)).cast("binary")) == F.col("crc")
    if halt:
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad checksum at lsn "), F.col("lsn").cast("string"))).cast("boolean"))
    return changes.where(good).select(*body)
