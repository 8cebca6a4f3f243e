"""Vectors, edges, changes and documents derived from the test tables, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.schema import DAY_MS, EDGE_TYPES, TemporalConfig

#: The time of all queries: 2024-02-01T00:00:00Z.
AT = 1_706_745_600_000
CONFIG = TemporalConfig(half_life_ms=7 * DAY_MS, blend=0.3, staleness_threshold=0.2)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    created = F.lit(AT) - (F.col("vec_id") * 37 % 60) * DAY_MS
    payload = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("parity"), (F.col("vec_id") % 2).cast("string"))
    return rows.select(
        F.col("vec_id").alias("id"), "embedding", payload.alias("payload"), created.alias("created_at"), created.alias("valid_from"),
        F.when(F.col("vec_id") % 11 == 0, created + 30 * DAY_MS).alias("valid_until"), (F.col("vec_id") % 4).cast("int").alias("shard"), "label")


def query(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


#: The query set of the batch searches and evaluations, which grows with the table.
WANTED = "vec_id % 50 = 0"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where(WANTED).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id")
    n = rows.count()
    kind = F.get(F.array(*[F.lit(t) for t in EDGE_TYPES]), (F.col("vec_id") % 6).cast("int"))
    both = F.explode(F.array((F.col("vec_id") * 7 + 3) % n, (F.col("vec_id") * 5 + 1) % n))
    return rows.select(F.col("vec_id").alias("src"), both.alias("tgt"), kind.alias("type"), (1.0 - (F.col("vec_id") % 10) / 20.0).cast("float").alias("weight"), F.lit(AT).alias("created_at"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("op"), "value")


#: The same in DuckDB, to stand after WITH.
V = f"""V AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, vec_id % 2 AS parity, {AT} - ((vec_id * 37) % 60) * {DAY_MS} AS created_at,
  CASE WHEN vec_id % 11 = 0 THEN {AT} - ((vec_id * 37) % 60) * {DAY_MS} + {30 * DAY_MS} END AS valid_until, (vec_id % 4)::INTEGER AS shard FROM embeddings)"""
Q = "Q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
QS = f"QS AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS qlabel FROM embeddings WHERE {WANTED})"
E = f"""N AS (SELECT count(*) AS n FROM embeddings),
E AS (SELECT vec_id AS src, tgt, list_extract([{', '.join(f"'{t}'" for t in EDGE_TYPES)}], (vec_id % 6 + 1)::INTEGER) AS type, (1.0 - (vec_id % 10) / 20.0)::FLOAT AS weight
  FROM (SELECT vec_id, unnest([(vec_id * 7 + 3) % n, (vec_id * 5 + 1) % n]) AS tgt FROM embeddings, N))"""
COS = "list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
L2 = "list_distance(e, q)"
TW = f"CASE WHEN {AT} <= created_at THEN 1.0::DOUBLE ELSE pow(2.0::DOUBLE, -({AT} - created_at)::DOUBLE / {7 * DAY_MS}.0) END"
LIVE = f"(valid_until IS NULL OR valid_until >= {AT}) AND created_at <= {AT}"
REASON = f"CASE WHEN tw < 0.2 THEN 'Vector is ' || (({AT} - created_at) // {DAY_MS})::VARCHAR || ' days old (temporal_score=' || substr(printf('%.6f', tw), 1, 5) || ')' END"
