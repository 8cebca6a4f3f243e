"""What a search looked at: counts, temporal scores, staleness warnings, contradiction alerts, as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.functions import temporal as t
from halflife.functions.codec import payload_filter
from halflife.operators.search import search
from halflife.schema import SearchOptions, TemporalConfig


def candidates(vectors: DataFrame, at: int, config: TemporalConfig, options: SearchOptions) -> DataFrame:
    """One row: rows seen, hidden by validity, pruned by the filter, excluded by the cutoff, scored; temporal scores of the scored."""
    valid, matches = t.is_valid_at(at), payload_filter(options.filter)
    weight = t.temporal_weight("created_at", at, config.half_life_ms)
    inside = t.passes_cutoff(weight, config.cutoff)
    rows = vectors.select(valid.alias("valid"), matches.alias("matches"), inside.alias("inside"), weight.alias("w"))
    kept = F.col("valid") & F.col("matches") & F.col("inside")
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if(F.col("valid") & ~F.col("matches")).alias("filter_pruned"),
        F.count_if(F.col("valid") & F.col("matches") & ~F.col("inside")).alias("cutoff_excluded"),
        F.count_if(kept).alias("distance_computations"),
        F.avg(F.when(kept, F.col("w"))).alias("avg_temporal_score"), F.min(F.when(kept, F.col("w"))).alias("min_temporal_score"),
        F.count_if(kept & (F.col("w") < config.staleness_threshold)).alias("n_stale"),
    )


def trace(vectors: DataFrame, edges: DataFrame | None, query: Sequence[float], at: int, config: TemporalConfig, options: SearchOptions = SearchOptions(), query_id: str = "", collection: str = "", strategy: str = "exact", latency_ms: float | None = None) -> DataFrame:
    """The one-row trace with arrays staleness_warnings and contradiction_alerts over the hits."""
    hits = search(vectors, query, at, config, options).select("id", "rank", "temporal_score", "created_at", "staleness_warning", "staleness_reason")
    warning = F.struct("id", t.age_days("created_at", at).alias("age_days"), "temporal_score", F.col("staleness_reason").alias("reason"))
    warnings = hits.where("staleness_warning").agg(F.array_sort(F.collect_list(warning)).alias("staleness_warnings"))
    out = candidates(vectors, at, config, options).crossJoin(warnings)  # one row each
    if edges is None:
        alerts = out.select(F.array().cast("array<struct<result_id:string,contradicted_by:string,edge_weight:double>>").alias("contradiction_alerts")).limit(1)
    else:
        near = edges.where("type = 'CONTRADICTS'").join(hits.select("id"), F.col("src") == F.col("id"))
        alerts = near.agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("result_id"), F.col("tgt").cast("string").alias("contradicted_by"), F.col("weight").cast("double").alias("edge_weight")))).alias("contradiction_alerts"))
    out = out.crossJoin(alerts)
    return out.select(F.lit(query_id).alias("query_id"), F.lit(strategy).alias("strategy"), F.lit(collection).alias("collection"), F.lit(options.hops).alias("hops"), F.lit(latency_ms).cast("double").alias("latency_ms"), "*")


def server_counters(events: DataFrame) -> DataFrame:
    """(metric, value): requests, searches, upserts and errors from a log with event_type."""
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    one = events.agg(F.count("*").alias("requests"), count("view").alias("searches"), count("purchase").alias("upserts"), count("error").alias("errors"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])))


def prometheus(metrics: DataFrame, prefix: str = "halflife") -> DataFrame:
    """(metric, text): exposition lines of (metric, value)."""
    name = F.concat(F.lit(f"{prefix}_"), "metric")
    return metrics.select("metric", F.concat(F.lit("# TYPE "), name, F.lit(" gauge\n"), name, F.lit(" "), F.col("value").cast("string")).alias("text"))


def trace_json(traces: DataFrame, service: str | None = None, exported_at: int | None = None) -> DataFrame:
    """One JSON text (value) a trace, warnings and alerts nested; with a service, a structured log line of it."""
    more = [] if service is None else [F.lit(service).alias("service"), F.lit("retrieval_trace").alias("type"), F.lit(exported_at).cast("long").alias("exported_at_ms")]
    return traces.select(F.to_json(F.struct(*traces.columns, *more)).alias("value"))


def otlp(traces: DataFrame, service: str, ended_at: int) -> DataFrame:
    """One OTLP request in JSON (value) a trace of trace(): a span from latency_ms before ended_at. For a text sink or foreachBatch; nothing is sent."""
    end = F.lit(ended_at).cast("long") * 1_000_000
    start = end - (F.coalesce("latency_ms", F.lit(0.0)) * 1_000_000).cast("long")
    key = F.sha2(F.concat_ws("\n", "query_id", "collection", end.cast("string")), 256)
    text = lambda name, value: F.struct(F.lit(name).alias("key"), F.struct(value.cast("string").alias("stringValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    number = lambda name, value: F.struct(F.lit(name).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), value.cast("double").alias("doubleValue")).alias("value"))
    span = F.struct(
        F.substring(key, 1, 32).alias("traceId"), F.substring(key, 33, 16).alias("spanId"), F.lit("search").alias("name"), F.lit(1).alias("kind"),
        start.cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano"),
        F.array(text("query_id", F.col("query_id")), text("strategy", F.col("strategy")), text("collection", F.col("collection")), number("latency_ms", F.col("latency_ms"))).alias("attributes"))
    scope = F.struct(F.array(span).alias("spans"))
    resource = F.struct(F.array(text("service.name", F.lit(service))).alias("attributes"))
    return traces.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))
