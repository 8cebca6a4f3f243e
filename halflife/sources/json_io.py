"""JSON in and out: vector records, edges, results, traces, registry, tenants, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halflife.functions.codec import edge_code
from halflife.operators.writes import with_defaults

EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType()), T.StructField("type", T.StringType()), T.StructField("weight", T.DoubleType())])
INLINE_EDGE = T.StructType([T.StructField("target_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("weight", T.DoubleType())])
RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.LongType()), T.StructField("valid_from", T.LongType()), T.StructField("valid_until", T.LongType()),
    T.StructField("ttl_seconds", T.LongType()), T.StructField("edges", T.ArrayType(INLINE_EDGE)),
])
REGISTRY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("index_type", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("n_shards", T.IntegerType()), T.StructField("n_replicas", T.IntegerType()), T.StructField("write_quorum", T.IntegerType()),
    T.StructField("temporal", T.StructType([T.StructField("half_life_ms", T.LongType()), T.StructField("blend", T.DoubleType()), T.StructField("staleness_threshold", T.DoubleType()), T.StructField("cutoff", T.DoubleType())])),
    T.StructField("agent", T.StructType([T.StructField("enabled", T.BooleanType()), T.StructField("agent_id", T.StringType()), T.StructField("ttl_seconds", T.LongType()), T.StructField("dedup_threshold", T.DoubleType()), T.StructField("cross_agent_readable", T.ArrayType(T.StringType()))])),
])
TENANT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("max_collections", T.LongType()), T.StructField("max_vectors", T.LongType()),
    T.StructField("enabled", T.BooleanType()), T.StructField("collection_prefixes", T.ArrayType(T.StringType())),
])


def vectors_from_json(lines: DataFrame, now_ms: int, column: str = "value") -> DataFrame:
    """Records of JSON text, with the defaults of a write; inline edges stay in the column edges.

    Text that is no JSON, or has no id or embedding, is left out; errors() has it.
    """
    rows = lines.select(F.from_json(column, RECORD).alias("r")).select("r.*").where(F.col("id").isNotNull() & (F.size("embedding") > 0))
    return with_defaults(rows, now_ms)


def errors(lines: DataFrame, column: str = "value") -> DataFrame:
    parsed = lines.select(column, F.from_json(column, RECORD).alias("r"))
    return parsed.where(F.col("r.id").isNull() | F.coalesce(F.size("r.embedding") <= 0, F.lit(True))).select(column)


def inline_edges(vectors: DataFrame) -> DataFrame:
    """The edges that came with the records, as rows of the edge table."""
    each = vectors.select(F.col("id").alias("src"), "created_at", F.explode("edges").alias("e"))
    return each.select("src", F.col("e.target_id").alias("tgt"), F.col("e.type").alias("type"), F.coalesce("e.weight", F.lit(1.0)).cast("float").alias("weight"), "created_at").where(edge_code(F.col("type")) >= 0)


def edges_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Edges of JSON arrays [{src, tgt, type, weight = 1}]; an unknown type fails the read."""
    e = lines.select(F.explode(F.from_json(column, T.ArrayType(EDGE))).alias("e")).select("e.*")
    return e.where(edge_code(F.col("type")) >= 0).select("src", "tgt", "type", F.coalesce("weight", F.lit(1.0)).cast("float").alias("weight"))


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def results_to_json(hits: DataFrame) -> DataFrame:
    """Search results without flags that are off and arrays that are empty."""
    out = hits
    if "staleness_warning" in hits.columns:
        out = out.withColumn("staleness_warning", F.when(F.col("staleness_warning"), True))
    for name in ("causal_neighbors", "contradicted_by", "entities"):
        if name in hits.columns:
            out = out.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    return to_json(out)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).option("multiLine", "true").json(path)


def read_tenants(spark: SparkSession, path: str) -> DataFrame:
    """Tenants without their keys."""
    rows = spark.read.schema(TENANT).option("multiLine", "true").json(path)
    return rows.select(F.col("id").alias("tenant"), "max_collections", "max_vectors", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("collection_prefixes", F.array().cast("array<string>")).alias("prefixes"))


def envelope(rows: DataFrame) -> DataFrame:
    """One text: {"status": "ok", "data": [...]} of a bounded result."""
    return rows.agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.collect_list(F.struct(*rows.columns)).alias("data"))).alias("value"))
