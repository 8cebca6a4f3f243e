"""Ranking quality: recall, ranks, gold and stale rates, nDCG, cohorts; durability and tenant reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halflife.functions.codec import durability_loss, durability_nines


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the mean over the queries of truth of the share of their k true ids that were found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    each = hit.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("recall"))
    return each.agg(F.avg("recall").alias("recall"), F.count("*").alias("n_queries"))


def gold_ranks(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, gold_rank, top1): queries has query_id and gold_id; a miss ranks k + 1; top1 is null without hits."""
    hits = found.where(F.col("rank") <= k)
    each = queries.join(hits, "query_id", "left")
    return each.groupBy("query_id", "gold_id").agg(
        F.coalesce(F.min(F.when(F.col("id") == F.col("gold_id"), F.col("rank"))), F.lit(k + 1)).alias("gold_rank"),
        F.min_by("id", "rank").alias("top1"))


def gold_summary(ranks: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """One row: gold_at_1, stale_at_1, mean and median gold rank, empty_rate. stale has query_id and stale_id."""
    if stale is None:
        flagged = ranks.withColumn("is_stale", F.lit(False))
    else:
        bad = stale.select("query_id", F.col("stale_id").alias("top1")).distinct().withColumn("is_stale", F.lit(True))
        flagged = ranks.join(bad, ["query_id", "top1"], "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return flagged.agg(
        share(F.coalesce(F.col("top1") == F.col("gold_id"), F.lit(False))).alias("gold_at_1"), share(F.coalesce("is_stale", F.lit(False))).alias("stale_at_1"),
        F.avg("gold_rank").alias("mean_gold_rank"), F.percentile("gold_rank", 0.5).alias("median_gold_rank"), share(F.col("top1").isNull()).alias("empty_rate"))


def ndcg(found: DataFrame, relevance: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ndcg): gains 2^rel - 1 over log2(rank + 1); 0 for a query without relevant ids or hits."""
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1)
    got = found.where(F.col("rank") <= k).join(relevance, ["query_id", "id"], "left").na.fill(0.0, ["rel"])
    got = got.groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")
    best = relevance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    return best.join(got, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def cohorts(ranks: DataFrame, cohort: DataFrame) -> DataFrame:
    """(cohort, n, gold_at_1) of gold_ranks() by the cohort (query_id, cohort)."""
    return ranks.join(cohort, "query_id").groupBy("cohort").agg(F.count("*").alias("n"), F.avg(F.when(F.col("top1") == F.col("gold_id"), 1.0).otherwise(0.0)).alias("gold_at_1"))


def shard_sizes(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("shard").agg(F.count("*").alias("n"))


def index_stats(vectors: DataFrame) -> DataFrame:
    """One row: rows, bytes of the vectors as floats, smallest and largest dimension."""
    return vectors.agg(F.count("*").alias("n_vectors"), F.sum(F.size("embedding") * 4).cast("long").alias("vector_bytes"), F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"))


def durability_table(spark, grid, p: float) -> DataFrame:
    """(k, m, loss, nines) of erasure codes with k data and m parity parts."""
    return spark.createDataFrame([(k, m, durability_loss(k, m, p), durability_nines(k, m, p)) for k, m in grid], "k int, m int, loss double, nines double")


def durability_report(nodes: DataFrame, k: int, m: int, p: float) -> DataFrame:
    """One row from (node_id, healthy): counts, expected loss and a status that tells whether parity still covers the failures."""
    failed = F.count_if(~F.col("healthy"))
    # The three statuses.
    status = F.when(failed == 0, "OK").when(failed <= m, "DEGRADED (repairing)").otherwise("CRITICAL — DATA LOSS RISK")
    return nodes.agg(F.count("*").alias("n_nodes"), F.count_if("healthy").alias("n_healthy"), failed.alias("n_failed"), status.alias("status")).select(
        "*", F.lit(durability_loss(k, m, p)).alias("p_loss_per_year"), F.lit(durability_nines(k, m, p)).alias("effective_nines"))


def health_gauges(report: DataFrame, at_risk: DataFrame, gaps: DataFrame) -> DataFrame:
    """(metric, value) for prometheus(): of durability_report(), scrub() and heartbeat_gaps()."""
    one = report.crossJoin(at_risk.agg(F.count_if("at_risk").alias("risk"), F.count("*").alias("scrubbed"))).crossJoin(gaps.agg(F.count("*").alias("gaps")))  # one row each
    named = {"nodes_healthy": "n_healthy", "nodes_failed": "n_failed", "durability_nines": "effective_nines", "p_data_loss_year": "p_loss_per_year", "segments_at_risk": "risk", "segments_scrubbed": "scrubbed", "failures": "gaps"}
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in named.items()])))


def report_text(report: DataFrame) -> DataFrame:
    return report.select(F.format_string("%s: %d of %d nodes healthy, %.2f nines", "status", "n_healthy", "n_nodes", "effective_nines").alias("text"))


def tenant_quota(collections: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant, n_collections, n_vectors, within_quota): collections (name, n_vectors) belong to a tenant by any of its prefixes.

    Tenants are a dimension table; a name that fits several tenants counts for each, once.
    """
    prefixes = tenants.select("tenant", F.explode("prefixes").alias("prefix"))
    own = collections.join(F.broadcast(prefixes), F.col("name").startswith(F.col("prefix"))).select("tenant", "name", "n_vectors").distinct()
    used = own.groupBy("tenant").agg(F.count("*").alias("n_collections"), F.sum("n_vectors").alias("n_vectors"))
    out = tenants.join(used, "tenant", "left").na.fill(0, ["n_collections", "n_vectors"])
    return out.select("tenant", "n_collections", "n_vectors", ((F.col("n_collections") <= F.col("max_collections")) & (F.col("n_vectors") <= F.col("max_vectors")) & F.col("enabled")).alias("within_quota"))


def heartbeat_gaps(beats: DataFrame, limit_ms: int) -> DataFrame:
    """(node_id, failed_at, recovered_at, gap_ms): gaps between a node's beats (node_id, at) that exceed the limit. Beats of one time have no gap."""
    order = Window.partitionBy("node_id").orderBy("at")
    gaps = beats.withColumn("before", F.lag("at").over(order)).withColumn("gap_ms", F.col("at") - F.col("before"))
    return gaps.where(F.col("gap_ms") > limit_ms).select("node_id", (F.col("before") + limit_ms).alias("failed_at"), F.col("at").alias("recovered_at"), "gap_ms")


def scrub(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """(segment_id, at_risk): segments whose checksum differs from the expected, or that are gone."""
    now = segments.select("segment_id", F.crc32(F.col("data")).alias("crc"))
    return expected.join(now, "segment_id", "left").select("segment_id", F.coalesce(F.col("crc") != F.col("expected_crc"), F.lit(True)).alias("at_risk"))
