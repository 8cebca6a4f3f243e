"""The queries over the test tables and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halflife.engine import Engine
from halflife.functions import codec
from halflife.functions import temporal as t
from halflife.functions import vector as v
from halflife.operators import drift, erasure, evaluate, graph, ivf, quantize, search, trace, writes
from halflife.plans import fixtures as fx
from halflife.plans.fixtures import AT, CONFIG, COS, DAY_MS, L2, LIVE, QS, REASON, TW, E, Q, V
from halflife.schema import AgentConfig, SearchOptions
from halflife.sources import json_io
from halflife.sources.scratch import scratch_path, stored
from halflife.sources.tables import Tables
from halflife.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


SCORES = ("score", "vector_score", "temporal_score")


def _scored_sql(sim: str, where: str = LIVE, beta: float = 0.3) -> str:
    return f"S AS (SELECT id, label, shard, created_at, {sim} AS sim, {TW} AS tw, {1 - beta} * ({sim}) + {beta} * ({TW}) AS score FROM V, Q WHERE {where})"


def _top_sql(sim: str, where: str = LIVE, k: int = 10, beta: float = 0.3, extra: str = "") -> str:
    return f"""WITH {V}, {Q}, {_scored_sql(sim, where, beta)}
SELECT (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS rank, id, round(score, 6) AS score, round(sim, 6) AS vector_score, round(tw, 6) AS temporal_score{extra}
FROM S ORDER BY score DESC, id LIMIT {k}"""


UNIT = f"(({COS}) + 1) / 2"


def _search(spark, sf_dir, options=SearchOptions(), config=CONFIG):
    hits = search.search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, config, options)
    return rounded(hits.select("rank", "id", *SCORES), *SCORES)


@query(f"""WITH {V}, {Q} SELECT id, round({COS}, 6) AS cosine, round({L2}, 6) AS l2, round({L2} * {L2}, 6) AS l2_squared, round(list_dot_product(e, q), 6) AS dot,
  round({UNIT}, 6) AS sim_cosine, round(1 / (1 + {L2}), 6) AS sim_l2, round(sqrt(list_dot_product(e, e)), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM V, Q""")
def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = fx.query(spark, sf_dir), "embedding"
    rows = fx.vectors(spark, sf_dir).select("id", v.cosine(e, q).alias("cosine"), v.l2_distance(e, q).alias("l2"), v.l2_squared(e, q).alias("l2_squared"), v.dot(e, q).alias("dot"),
                                            v.similarity(e, q).alias("sim_cosine"), v.similarity(e, q, "l2").alias("sim_l2"), v.norm(e).alias("norm"), v.norm(v.normalised(e)).alias("unit_norm"))
    return rounded(rows, *rows.columns[1:])


@query(f"""WITH {V}, T AS (SELECT *, {TW} AS tw FROM V) SELECT id, round(tw, 6) AS weight, tw < 0.2 AS stale, ({AT} - created_at) // {DAY_MS} AS age_days, {REASON} AS reason,
  NOT tw < 0.05 AS inside_cutoff, {LIVE} AS valid, round(0.7 * 0.8 + 0.3 * tw, 9) AS blended FROM T""")
def temporal_scores(spark, sf_dir):
    w = t.temporal_weight("created_at", AT, CONFIG.half_life_ms)
    return rounded(fx.vectors(spark, sf_dir).select(
        "id", w.alias("weight"), t.is_stale(w, CONFIG).alias("stale"), t.age_days("created_at", AT).alias("age_days"), t.staleness_reason(w, "created_at", AT, CONFIG).alias("reason"),
        t.passes_cutoff(w, 0.05).alias("inside_cutoff"), t.is_valid_at(AT).alias("valid"), F.round(t.blend(F.lit(0.8), w, 0.3), 9).alias("blended")), "weight")


@query(_top_sql(UNIT, extra=f", tw < 0.2 AS staleness_warning, {REASON} AS staleness_reason"))
def flat_topk_blend(spark, sf_dir):
    hits = search.search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG)
    return rounded(hits.select("rank", "id", *SCORES, "staleness_warning", "staleness_reason"), *SCORES)


@query(_top_sql(f"1 / (1 + {L2})"))
def flat_topk_l2(spark, sf_dir):
    return _search(spark, sf_dir, SearchOptions(metric="l2"))


@query(_top_sql("list_dot_product(e, q)"))
def flat_topk_dot(spark, sf_dir):
    return _search(spark, sf_dir, SearchOptions(metric="dot"))


@query(_top_sql(UNIT, f"{LIVE} AND label = 3"))
def filtered_topk(spark, sf_dir):
    return _search(spark, sf_dir, SearchOptions(filter="label=3"))


@query(_top_sql(UNIT, f"{LIVE} AND NOT ({TW}) < 0.2", 20))
def temporal_cutoff_topk(spark, sf_dir):
    return _search(spark, sf_dir, SearchOptions(top_k=20), replace(CONFIG, cutoff=0.2))


@query(_top_sql(COS, beta=0.6))
def raw_space_topk(spark, sf_dir):
    return _search(spark, sf_dir, SearchOptions(blend=0.6, score_space="raw"))


@query(_top_sql(UNIT, k=1))
def search_one(spark, sf_dir):
    return rounded(search.search_one(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG).select("rank", "id", *SCORES), *SCORES)


@query(f"""WITH {V}, {Q} SELECT (row_number() OVER (ORDER BY {COS} DESC, id))::INTEGER AS rank, id, round({COS}, 6) AS score FROM V, Q
WHERE ({AT} - created_at) // {DAY_MS} <= 14 ORDER BY rank LIMIT 10""")
def age_window_topk(spark, sf_dir):
    return rounded(search.age_window_search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, 14, 10), "score")


@query(f"WITH {V}, {Q} SELECT (row_number() OVER (ORDER BY {COS} DESC, id))::INTEGER AS rank, id, round({COS}, 6) AS score FROM V, Q ORDER BY rank LIMIT 10")
def cosine_topk(spark, sf_dir):
    return rounded(search.cosine_search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), 10), "score")


@query(f"WITH {V}, {Q} SELECT (row_number() OVER (ORDER BY {L2} * {L2}, id))::INTEGER AS rank, id, round({L2} * {L2}, 6) AS distance FROM V, Q ORDER BY rank LIMIT 10")
def distance_topk(spark, sf_dir):
    return rounded(search.distances(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), 10, "l2"), "distance")


def _batch_sql(k: int = 10) -> str:
    return f"""{V}, {QS}, B AS (SELECT query_id, qlabel, id, label, {UNIT} AS sim, {TW} AS tw, 0.7 * ({UNIT}) + 0.3 * ({TW}) AS score FROM V, QS WHERE {LIVE}),
R AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM B), T AS (SELECT * FROM R WHERE rank <= {k})"""


@query(f"WITH {_batch_sql()} SELECT query_id, rank, id, round(score, 6) AS score, round(sim, 6) AS vector_score, round(tw, 6) AS temporal_score FROM T")
def batch_topk(spark, sf_dir):
    return rounded(search.batch_search(fx.vectors(spark, sf_dir), fx.queries(spark, sf_dir), AT, CONFIG), *SCORES)


@query(f"""WITH {V}, {Q}, P AS (SELECT * FROM V, Q ORDER BY {COS} DESC, id LIMIT 40), S AS (SELECT id, {COS} AS sim, {TW} AS tw, 0.7 * ({COS}) + 0.3 * ({TW}) AS score FROM P WHERE {LIVE})
SELECT (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS rank, id, round(score, 6) AS score, round(sim, 6) AS vector_score, round(tw, 6) AS temporal_score FROM S ORDER BY rank LIMIT 10""")
def overfetch_rerank(spark, sf_dir):
    return rounded(search.overfetch_search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG).select("rank", "id", *SCORES), *SCORES)


@query(_top_sql(UNIT, extra=", shard"))
def shard_merge_topk(spark, sf_dir):
    return rounded(search.shard_search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG), *SCORES)


@query("""SELECT (h % 4)::INTEGER AS shard, count(*) AS n FROM (SELECT list_reduce(list_transform(string_split('vec_' || vec_id, ''), lambda c: ascii(c)::HUGEINT),
  lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM embeddings) GROUP BY 1""")
def fnv_shard_sizes(spark, sf_dir):
    ids = F.concat(F.lit("vec_"), F.col("id").cast("string"))
    return evaluate.shard_sizes(fx.vectors(spark, sf_dir).select(codec.shard_of(ids, 4).alias("shard")))


@query(f"WITH {V} SELECT shard, count(*) AS n FROM V GROUP BY shard")
def shard_sizes(spark, sf_dir):
    return evaluate.shard_sizes(fx.vectors(spark, sf_dir))


@query(f"WITH {V} SELECT count(*) AS n_vectors, (sum(len(e)) * 4)::BIGINT AS vector_bytes, min(len(e))::INTEGER AS min_dim, max(len(e))::INTEGER AS max_dim FROM V")
def index_stats(spark, sf_dir):
    return evaluate.index_stats(fx.vectors(spark, sf_dir))


@query(f"""WITH {V}, N AS (SELECT count(*) AS n FROM V) SELECT id, created_at FROM V WHERE id % 7 <> 0
UNION ALL SELECT id, created_at + 1 FROM V WHERE id % 7 = 0 UNION ALL SELECT id + n, created_at + 1 FROM V, N WHERE id % 7 = 1""")
def upsert_last_wins(spark, sf_dir):
    old = fx.vectors(spark, sf_dir).select("id", "created_at")
    n = old.count()
    new = old.where("id % 7 = 0").unionAll(old.where("id % 7 = 1").select(F.col("id") + n, "created_at"))
    twice = new.withColumn("lsn", F.lit(1)).unionAll(new.select("id", F.col("created_at") + 1, F.lit(2)))
    return writes.upsert(old, twice, "lsn")


@query(f"WITH {V} SELECT id FROM V WHERE id % 3 <> 0")
def delete_anti(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select("id")
    return writes.delete(rows, rows.where("id % 3 = 0"))


@query(f"WITH {V} SELECT count(*) AS n_deleted FROM V WHERE id % 3 = 0")
def delete_count(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select("id")
    return writes.deleted_count(rows, rows.where("id % 3 = 0").unionAll(rows.select(F.col("id") + 1_000_000)))


@query(f"WITH {V} SELECT id FROM V WHERE valid_until IS NULL OR valid_until >= {AT}")
def purge_expired(spark, sf_dir):
    return writes.purge_expired(fx.vectors(spark, sf_dir), AT).select("id")


@query(f"WITH {V} SELECT id, created_at + id * 1000 AS valid_until, created_at + 3600000 AS agent_until FROM V")
def ttl_apply(spark, sf_dir):
    rows = writes.set_ttl(fx.vectors(spark, sf_dir), F.col("id"))
    agent = writes.apply_agent(rows, AgentConfig(enabled=True, ttl_seconds=3600)).select("id", F.col("valid_until").alias("agent_until"))
    return rows.select("id", "valid_until").join(agent, "id")


@query("""SELECT id, lsn, value FROM (SELECT user_id AS id, event_id AS lsn, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'""")
def wal_replay_state(spark, sf_dir):
    return writes.replay(fx.changes(spark, sf_dir)).select("id", "lsn", "value")


@query("SELECT event_id AS lsn FROM events WHERE event_id >= 500")
def wal_truncate(spark, sf_dir):
    log = writes.with_checksum(fx.changes(spark, sf_dir))
    return writes.truncate_before(writes.verified(log), 500).select("lsn")


@query(f"WITH {V} SELECT id FROM V AS b WHERE NOT EXISTS (SELECT 1 FROM V AS a WHERE (a.created_at, a.id) < (b.created_at, b.id) AND (list_cosine_similarity(a.e, b.e) + 1) / 2 >= 0.7)")
def dedup_near_duplicates(spark, sf_dir):
    return writes.dedup(fx.vectors(spark, sf_dir), 0.7).select("id")


def _hops_sql(hops: int, kind: str = "", seeds: str = "SELECT 0 AS seed") -> str:
    only = f"WHERE type = '{kind}'" if kind else ""
    return f"""S AS ({seeds}), X AS (SELECT DISTINCT src, tgt FROM E {only}),
W(seed, node, hop) AS (SELECT seed, seed::BIGINT, 0 FROM S UNION SELECT seed, tgt, hop + 1 FROM W JOIN X ON node = src WHERE hop < {hops}),
R AS (SELECT seed, node, min(hop)::INTEGER AS hop FROM W GROUP BY seed, node HAVING min(hop) > 0)"""


def _neighbours(hops: int):
    def run(spark, sf_dir):
        return graph.neighbours(fx.edges(spark, sf_dir), 0, hops)

    run.__name__ = f"graph_neighbors_{hops}hop"
    return query(f"WITH RECURSIVE {E}, {_hops_sql(hops)} SELECT node, hop FROM R")(run)


for _hops in (1, 2, 3):
    _neighbours(_hops)


@query(f"WITH {E} SELECT src, tgt, round(weight, 6) AS weight FROM E WHERE src = 7 AND type = 'CONTRADICTS'")
def graph_out_edges(spark, sf_dir):
    return graph.out_edges(fx.edges(spark, sf_dir), 7, "CONTRADICTS").select("src", "tgt", F.round("weight", 6).alias("weight"))


@query(f"WITH {E} SELECT DISTINCT tgt AS node FROM E WHERE src = 1 AND type = 'CONTRADICTS' AND tgt <> 1")
def graph_contradictions(spark, sf_dir):
    return graph.contradictions(fx.edges(spark, sf_dir), 1)


@query(f"WITH RECURSIVE {E}, {_hops_sql(2, 'ENTITY_OF', 'SELECT 4 AS seed')} SELECT node FROM R")
def graph_entity(spark, sf_dir):
    return graph.entity(fx.edges(spark, sf_dir), 4)


@query(f"WITH RECURSIVE {E}, {_hops_sql(5)} SELECT count(*) > 0 AS path_exists, min(hop) AS hops FROM R WHERE node = 8")
def graph_path(spark, sf_dir):
    return graph.path_exists(fx.edges(spark, sf_dir), 0, 8)


@query(f"WITH RECURSIVE {E}, {_hops_sql(2, seeds='SELECT vec_id AS seed FROM embeddings WHERE vec_id % 50 = 0')} SELECT seed AS node FROM S UNION SELECT node FROM R")
def graph_expand(spark, sf_dir):
    return graph.expand(fx.edges(spark, sf_dir), fx.queries(spark, sf_dir).select("query_id"), 2)


@query(f"""WITH {E}, B AS (SELECT src AS node, 1 AS o, 0 AS i FROM E UNION ALL SELECT tgt, 0, 1 FROM E) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM B GROUP BY node""")
def graph_degree(spark, sf_dir):
    return graph.degrees(fx.edges(spark, sf_dir))


@query(f"WITH {E} SELECT (SELECT count(*) FROM E) AS n_edges, (SELECT count(*) FROM (SELECT src FROM E UNION SELECT tgt FROM E)) AS n_nodes")
def graph_counts(spark, sf_dir):
    return graph.counts(fx.edges(spark, sf_dir))


@query(f"WITH {E} SELECT src, tgt FROM E WHERE src > 9 AND tgt > 9 AND NOT (src = 20 AND tgt = 143)")
def graph_removals(spark, sf_dir):
    gone = fx.vectors(spark, sf_dir).where("id < 10").select("id")
    return graph.remove_edges(graph.remove_nodes(fx.edges(spark, sf_dir), gone), 20, 143).select("src", "tgt")


@query(f"WITH {E} SELECT src, tgt, type, round(weight, 6) AS weight FROM E UNION ALL SELECT src, tgt, 'SUPPORTS', 1.0 FROM E WHERE src < 3")
def graph_add_edges(spark, sf_dir):
    e = fx.edges(spark, sf_dir)
    return graph.add_edges(e, e.where("src < 3").select("src", "tgt", F.lit("SUPPORTS").alias("type"))).select("src", "tgt", "type", F.round("weight", 6).alias("weight"))


def _decorated_sql(name: str, hops: int, kind: str) -> str:
    return f"""WITH RECURSIVE {V}, {Q}, {_scored_sql(UNIT)}, H AS (SELECT id, score FROM S ORDER BY score DESC, id LIMIT 10), {E},
X AS (SELECT DISTINCT src, tgt FROM E {f"WHERE type = '{kind}'" if kind else ''}),
W(seed, node, hop) AS (SELECT id, id, 0 FROM H UNION SELECT seed, tgt, hop + 1 FROM W JOIN X ON node = src WHERE hop < {hops})
SELECT id, round(score, 6) AS score, coalesce(string_agg(DISTINCT node::VARCHAR, ',' ORDER BY node::VARCHAR) FILTER (node <> id), '') AS {name} FROM H LEFT JOIN W ON id = seed GROUP BY id, score"""


def _decorated(spark, sf_dir, name: str, options: SearchOptions) -> DataFrame:
    hits = search.search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG, options)
    out = graph.decorate(hits, fx.edges(spark, sf_dir), options)
    return rounded(out.select("id", "score", graph.joined(F.array_sort(F.transform(name, lambda x: x.cast("string")))).alias(name)), "score")


@query(_decorated_sql("causal_neighbors", 2, ""))
def search_causal_expand(spark, sf_dir):
    return _decorated(spark, sf_dir, "causal_neighbors", SearchOptions(mode="causal_expand", hops=2))


@query(_decorated_sql("contradicted_by", 1, "CONTRADICTS"))
def search_contradiction(spark, sf_dir):
    return _decorated(spark, sf_dir, "contradicted_by", SearchOptions(mode="contradiction_check"))


@query(_decorated_sql("entities", 2, "ENTITY_OF"))
def search_entity(spark, sf_dir):
    return _decorated(spark, sf_dir, "entities", SearchOptions(mode="entity_resolve"))


@query(f"""WITH {V}, T AS (SELECT {LIVE} AS ok, label = 3 AS m, {TW} AS tw FROM V) SELECT count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_invalid, count(*) FILTER (ok AND NOT m) AS filter_pruned,
  count(*) FILTER (ok AND m AND tw < 0.05) AS cutoff_excluded, count(*) FILTER (ok AND m AND NOT tw < 0.05) AS distance_computations,
  round(avg(tw) FILTER (ok AND m AND NOT tw < 0.05), 6) AS avg_temporal_score, round(min(tw) FILTER (ok AND m AND NOT tw < 0.05), 6) AS min_temporal_score,
  count(*) FILTER (ok AND m AND NOT tw < 0.05 AND tw < 0.2) AS n_stale FROM T""")
def retrieval_trace(spark, sf_dir):
    rows = trace.candidates(fx.vectors(spark, sf_dir), AT, replace(CONFIG, cutoff=0.05), SearchOptions(filter="label=3"))
    return rounded(rows, "avg_temporal_score", "min_temporal_score")


@query(f"""WITH {V}, {Q}, {_scored_sql(UNIT)}, H AS (SELECT * FROM S ORDER BY score DESC, id LIMIT 10), {E}
SELECT (SELECT count(*) FROM H WHERE tw < 0.2) AS n_warnings, (SELECT count(*) FROM H JOIN E ON id = src WHERE type = 'CONTRADICTS') AS n_alerts, (SELECT count(*) FROM V) AS n_rows""")
def trace_alerts(spark, sf_dir):
    rows = trace.trace(fx.vectors(spark, sf_dir), fx.edges(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG)
    return rows.select(F.size("staleness_warnings").cast("long").alias("n_warnings"), F.size("contradiction_alerts").cast("long").alias("n_alerts"), "n_rows")


@query("""SELECT unnest(['requests', 'searches', 'upserts', 'errors']) AS metric, unnest([count(*), count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'purchase'), count(*) FILTER (event_type = 'error')]) AS value FROM events""")
def server_counters(spark, sf_dir):
    return trace.server_counters(fx.read(spark, sf_dir, "events"))


@query("""WITH c AS (SELECT unnest(['requests', 'errors']) AS metric, unnest([count(*), count(*) FILTER (event_type = 'error')]) AS value FROM events)
SELECT metric, '# TYPE halflife_' || metric || ' gauge' || chr(10) || 'halflife_' || metric || ' ' || value AS text FROM c""")
def prometheus_text(spark, sf_dir):
    return trace.prometheus(trace.server_counters(fx.read(spark, sf_dir, "events")).where("metric in ('requests', 'errors')"))


def _found(spark, sf_dir) -> DataFrame:
    return search.batch_search(fx.vectors(spark, sf_dir), fx.queries(spark, sf_dir), AT, CONFIG)


def _cosine_truth(spark, sf_dir) -> DataFrame:
    return search.batch_search(fx.vectors(spark, sf_dir), fx.queries(spark, sf_dir), AT, CONFIG, SearchOptions(blend=0.0))


TRUTH = f"C AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS n FROM B) WHERE n <= 10)"


@query(f"""WITH {_batch_sql()}, {TRUTH}, H AS (SELECT C.query_id, count(T.id) / 10.0 AS recall FROM C LEFT JOIN T USING (query_id, id) GROUP BY C.query_id)
SELECT round(avg(recall), 6)::DOUBLE AS recall, count(*) AS n_queries FROM H""")
def eval_recall(spark, sf_dir):
    return rounded(evaluate.recall_at_k(_found(spark, sf_dir), _cosine_truth(spark, sf_dir), 10), "recall")


def _gold_of_labels(spark, sf_dir) -> DataFrame:
    """(label, gold_id): the freshest row of a label, then the smallest id."""
    return t_live(spark, sf_dir).groupBy("label").agg(F.min_by("id", F.struct(-F.col("created_at"), F.col("id"))).alias("gold_id"))


def _gold(spark, sf_dir) -> DataFrame:
    """The gold row of a query is that of its label, so queries never meet the rows of their label."""
    return fx.queries(spark, sf_dir).select("query_id", "label").join(_gold_of_labels(spark, sf_dir), "label").select("query_id", "gold_id")


def t_live(spark, sf_dir) -> DataFrame:
    return search.live(fx.vectors(spark, sf_dir), AT).select("id", "label", "created_at")


GOLD = f"""G AS (SELECT query_id, id AS gold_id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS n FROM QS JOIN V ON label = qlabel WHERE {LIVE}) WHERE n = 1),
K AS (SELECT G.query_id, gold_id, coalesce(min(rank) FILTER (id = gold_id), 11) AS gold_rank, min(id) FILTER (rank = 1) AS top1 FROM G LEFT JOIN T USING (query_id) GROUP BY G.query_id, gold_id)"""


@query(f"""WITH {_batch_sql()}, {GOLD} SELECT avg(CASE WHEN top1 = gold_id THEN 1.0 ELSE 0.0 END)::DOUBLE AS gold_at_1,
  avg(CASE WHEN top1 IN (SELECT id FROM V WHERE ({TW}) < 0.2) THEN 1.0 ELSE 0.0 END)::DOUBLE AS stale_at_1, avg(gold_rank)::DOUBLE AS mean_gold_rank,
  quantile_cont(gold_rank::DOUBLE, 0.5) AS median_gold_rank, avg(CASE WHEN top1 IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS empty_rate FROM K""")
def eval_gold_rank(spark, sf_dir):
    old = fx.vectors(spark, sf_dir).where(t.is_stale(t.temporal_weight("created_at", AT, CONFIG.half_life_ms), CONFIG)).select(F.col("id").alias("stale_id"))
    found = stored(_found(spark, sf_dir), "found")  # it is read twice
    stale = found.select("query_id", "id").join(old, F.col("id") == F.col("stale_id")).select("query_id", "stale_id")
    return evaluate.gold_summary(evaluate.gold_ranks(found, _gold(spark, sf_dir), 10), stale)


@query(f"""WITH {_batch_sql()}, {GOLD}, L AS (SELECT query_id, id, CASE WHEN id = gold_id THEN 3.0 ELSE 1.0 END AS rel FROM QS JOIN V ON label = qlabel JOIN G USING (query_id) WHERE {LIVE}),
I AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(n + 1)) AS idcg FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS n FROM L) WHERE n <= 5 GROUP BY query_id),
D AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM T JOIN L USING (query_id, id) WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM I LEFT JOIN D USING (query_id)""")
def eval_ndcg(spark, sf_dir):
    found, live, gold = stored(_found(spark, sf_dir), "found"), t_live(spark, sf_dir).select("label", "id"), _gold_of_labels(spark, sf_dir)
    asked = fx.queries(spark, sf_dir).select("query_id", "label")
    # Of a query's relevant rows only hits and the five best count: the gold row and the smallest ids of its label.
    first = live.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("n <= 5").select("label", "id")
    ideal = first.unionAll(gold.select("label", F.col("gold_id").alias("id"))).distinct()
    hits = found.select("query_id", "id").join(live, "id").join(asked, ["query_id", "label"])
    rows = asked.join(ideal, "label").select("query_id", "label", "id").unionByName(hits).distinct().join(gold, "label")
    relevance = rows.select("query_id", "id", F.when(F.col("id") == F.col("gold_id"), 3.0).otherwise(1.0).alias("rel"))
    return rounded(evaluate.ndcg(found, relevance), "ndcg")


@query(f"WITH {_batch_sql()}, {GOLD} SELECT query_id % 2 AS cohort, count(*) AS n, avg(CASE WHEN top1 = gold_id THEN 1.0 ELSE 0.0 END)::DOUBLE AS gold_at_1 FROM K GROUP BY 1")
def eval_cohort(spark, sf_dir):
    ranks = evaluate.gold_ranks(_found(spark, sf_dir), _gold(spark, sf_dir), 10)
    return evaluate.cohorts(ranks, fx.queries(spark, sf_dir).select("query_id", (F.col("query_id") % 2).alias("cohort")))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents),
h AS (SELECT doc_id, w, sha256(w) AS h FROM w WHERE w <> ''),
b AS (SELECT doc_id, ('0x' || substr(h, 63, 2))::INTEGER & 127 AS bucket, sum(CASE WHEN ('0x' || substr(h, 62, 1))::INTEGER & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (1 + 0.15::DOUBLE * length(w))) AS x FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round(x / n, 6) AS weight FROM b JOIN n USING (doc_id) WHERE n > 0 AND abs(x) > 1e-9""")
def doc_hashed_embedding(spark, sf_dir):
    # Sums that cancel leave rounding noise, which differs by the order of addition.
    rows = codec.hashed_embedding(fx.read(spark, sf_dir, "documents"))
    return rounded(rows.where(F.abs("weight") > 1e-12), "weight")


@query(f"WITH {V} SELECT id, id % 5 <> 0 AS migrated, CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END AS model_version, round(CASE WHEN id % 5 <> 0 THEN -1 ELSE 1 END * e[1], 6) AS first FROM V")
def drift_migrate(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir)
    new = rows.where("id % 5 <> 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return drift.migrate(rows, new).select("id", "migrated", "model_version", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"WITH {V} SELECT 'COMPLETE' AS phase, count(*) AS total, count(*) FILTER (id % 5 <> 0) AS migrated, count(*) FILTER (id % 5 = 0) AS skipped, 100.0::DOUBLE AS pct FROM V")
def drift_progress(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir)
    return drift.progress(drift.migrate(rows, rows.where("id % 5 <> 0").select("id", "embedding")))


@query("""WITH c AS (SELECT CASE WHEN label < 5 THEN 'team_a_' ELSE 'team_b_' END || label AS name, count(*) AS n FROM embeddings GROUP BY 1)
SELECT tenant, count(name) AS n_collections, coalesce(sum(n), 0)::BIGINT AS n_vectors, count(name) <= 5 AND coalesce(sum(n), 0) <= cap AS within_quota
FROM (VALUES ('a', 'team_a_', 1000000), ('b', 'team_b_', 10), ('c', 'team_c_', 10)) t(tenant, prefix, cap) LEFT JOIN c ON starts_with(name, prefix) GROUP BY tenant, cap""")
def tenant_quota(spark, sf_dir):
    name = F.concat(F.when(F.col("label") < 5, "team_a_").otherwise("team_b_"), F.col("label").cast("string"))
    collections = fx.read(spark, sf_dir, "embeddings").groupBy(name.alias("name")).agg(F.count("*").alias("n_vectors"))
    tenants = spark.createDataFrame([("a", ["team_a_"], 5, 1_000_000, True), ("b", ["team_b_"], 5, 10, True), ("c", ["team_c_"], 5, 10, True)], "tenant string, prefixes array<string>, max_collections long, max_vectors long, enabled boolean")
    return evaluate.tenant_quota(collections, tenants)


@query("""WITH g(k, m) AS (VALUES (4, 2), (6, 3), (10, 4), (14, 4)), n AS (SELECT k, m, unnest(range(m + 1, k + m + 1)) AS i FROM g),
l AS (SELECT k, m, sum(exp(lgamma(k + m + 1) - lgamma(i + 1) - lgamma(k + m - i + 1)) * pow(0.004, i) * pow(0.996, k + m - i)) AS loss FROM n GROUP BY k, m)
SELECT k, m, round(-log10(loss) + 2, 4) AS nines FROM l""")
def durability_table(spark, sf_dir):
    return evaluate.durability_table(spark, [(4, 2), (6, 3), (10, 4), (14, 4)], 0.004).select("k", "m", F.round("nines", 4).alias("nines"))


@query("SELECT count(*) AS n_nodes, count(*) FILTER (s_suppkey % 5 <> 0) AS n_healthy, count(*) FILTER (s_suppkey % 5 = 0) AS n_failed, CASE WHEN count(*) FILTER (s_suppkey % 5 = 0) = 0 THEN 'OK' WHEN count(*) FILTER (s_suppkey % 5 = 0) <= 4 THEN 'DEGRADED (repairing)' ELSE 'CRITICAL — DATA LOSS RISK' END AS status FROM supplier")
def durability_report(spark, sf_dir):
    nodes = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 5 != 0).alias("healthy"))
    return evaluate.durability_report(nodes, 10, 4, 0.004).select("n_nodes", "n_healthy", "n_failed", "status")


def _beats(spark, sf_dir) -> DataFrame:
    return fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id")


@query("""WITH b AS (SELECT user_id AS node_id, (epoch_us(ts) // 1000) AS beat, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS before FROM events)
SELECT node_id, before + 86400000 AS failed_at, beat AS recovered_at, beat - before AS gap_ms FROM b WHERE beat - before > 86400000""")
def heartbeat_failures(spark, sf_dir):
    return evaluate.heartbeat_gaps(_beats(spark, sf_dir), DAY_MS)


@query("SELECT o_orderkey AS segment_id, o_orderkey % 9 = 0 AS at_risk FROM orders")
def scrub_segments(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderkey").cast("string").cast("binary").alias("data"))
    expected = rows.select("segment_id", F.crc32("data").alias("expected_crc"))
    broken = rows.where("segment_id % 18 <> 0").withColumn("data", F.when(F.col("segment_id") % 9 == 0, F.lit(b"broken")).otherwise(F.col("data")))
    return evaluate.scrub(broken, expected)


@query(f"WITH {V} SELECT id::VARCHAR AS id, created_at, created_at AS valid_from, created_at + 5000 AS valid_until, label::VARCHAR AS label FROM V")
def json_round_trip(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "embedding", "payload", "created_at", F.lit(5).alias("ttl_seconds"))
    back = json_io.vectors_from_json(json_io.to_json(rows), AT)
    return back.select("id", "created_at", "valid_from", "valid_until", F.col("payload")["label"].alias("label"))


@query(f"WITH {E} SELECT src::VARCHAR AS src, tgt::VARCHAR AS tgt, type, round(weight::DOUBLE, 6) AS weight, (src % 6)::INTEGER AS code FROM E")
def edges_json(spark, sf_dir):
    e = fx.edges(spark, sf_dir).select(F.to_json(F.array(F.struct(F.col("src").cast("string").alias("src"), F.col("tgt").cast("string").alias("tgt"), "type", "weight"))).alias("value"))
    return json_io.edges_from_json(e).select("src", "tgt", "type", F.round(F.col("weight").cast("double"), 6).alias("weight"), codec.edge_code(F.col("type")).cast("int").alias("code"))


@query(f"""WITH {V}, {Q}, {_scored_sql(UNIT)} SELECT id, tw < 0.2 AS flagged FROM S ORDER BY score DESC, id LIMIT 10""")
def results_json(spark, sf_dir):
    hits = search.search(fx.vectors(spark, sf_dir), fx.query(spark, sf_dir), AT, CONFIG)
    text = json_io.results_to_json(hits)
    return text.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.staleness_warning").isNotNull().alias("flagged"))


@query(f"WITH {V}, {Q} SELECT id, round({COS}, 6) AS cosine, round(0.7 * ({UNIT}) + 0.3 * ({TW}), 6) AS score, {LIVE} AS valid FROM V, Q")
def sql_functions(spark, sf_dir):
    v.register_sql(spark)
    q = F.array(*[F.lit(float(x)) for x in fx.query(spark, sf_dir)])
    fx.vectors(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("e"), q.alias("q"), "created_at", "valid_from", "valid_until").createOrReplaceTempView("halflife_v")
    return spark.sql(f"""SELECT id, round(hl_cosine(e, q), 6) AS cosine, round(hl_blend(hl_similarity(e, q), hl_temporal_weight(created_at, {AT}, {7 * DAY_MS}), 0.3D), 6) AS score,
      hl_is_valid(valid_from, valid_until, {AT}) AS valid FROM halflife_v""")


#: What is written once a session and table, as an index is, by (application, table, kind).
_WRITTEN: dict = {}


def _written(spark, sf_dir, kind: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _WRITTEN:
        _WRITTEN[key] = build(fx.vectors(spark, sf_dir), scratch_path(spark, kind))
    return _WRITTEN[key]


def _lists(spark, sf_dir) -> ivf.Stored:
    """16 lists, and as many of them probed as hold 0.95 of what a sample of rows finds by the exact search."""
    def build(rows, path):
        lists = ivf.store(rows, path, 16)
        return ivf.save_probes(spark, lists, ivf.probes_for(lists, rows, ivf.sample_queries(rows), 0.95, AT, CONFIG))

    return _written(spark, sf_dir, "lists", build)


def _codes(spark, sf_dir) -> tuple[quantize.Codebook, str]:
    """32 codes of a byte for 64 floats, an eighth of the vectors' bytes, or more where they find less than 0.95 of what a sample of rows finds by the exact search."""
    def build(rows, path):
        return quantize.store(rows, ivf.sample_queries(rows), path, 32, 256, 0.95, AT, CONFIG)

    return _written(spark, sf_dir, "codes", build)


@query()
def ivf_topk(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return rounded(ivf.ivf_search(lists.rows(spark), lists.centres, fx.query(spark, sf_dir), lists.n_probe, AT, CONFIG).select("rank", "id", *SCORES), *SCORES)


def _ivf_found(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return ivf.batch_ivf_search(lists.rows(spark), lists.centres, fx.queries(spark, sf_dir), lists.n_probe, AT, CONFIG)


def _pq_found(spark, sf_dir, factor: int):
    book, path = _codes(spark, sf_dir)
    return quantize.batch_pq_search(spark.read.parquet(path), book, fx.queries(spark, sf_dir), AT, CONFIG, factor=factor)


#: Candidates by codes for each hit wanted, scored again with their vectors.
FACTOR = 20


def _index_recall(spark, sf_dir) -> DataFrame:
    """(index, recall, n_queries) against the exact search. Codes alone are held against the exact search with the similarity that they approximate."""
    truth = _found(spark, sf_dir)
    squared = search.batch_search(fx.vectors(spark, sf_dir), fx.queries(spark, sf_dir), AT, CONFIG, metric="l2_squared")
    each = {"ivf": (_ivf_found(spark, sf_dir), truth), "pq": (_pq_found(spark, sf_dir, 0), squared), "pq_rescored": (_pq_found(spark, sf_dir, FACTOR), truth)}
    return reduce(DataFrame.unionAll, [evaluate.recall_at_k(found, exact, 10).select(F.lit(n).alias("index"), "recall", "n_queries") for n, (found, exact) in each.items()])


@query()
def ivf_recall(spark, sf_dir):
    return _index_recall(spark, sf_dir).where("index = 'ivf'").drop("index")


@query()
def pq_recall(spark, sf_dir):
    return _index_recall(spark, sf_dir).where("index <> 'ivf'")


@query("SELECT unnest(['ivf', 'pq', 'pq_rescored']) AS index, true AS enough, count(*) AS n_queries FROM embeddings WHERE vec_id % 50 = 0")
def index_recall_enough(spark, sf_dir):
    return _index_recall(spark, sf_dir).select("index", (F.col("recall") >= 0.9).alias("enough"), "n_queries")


@query()
def pq_topk(spark, sf_dir):
    book, path = _codes(spark, sf_dir)
    return rounded(quantize.pq_search(spark.read.parquet(path), book, fx.query(spark, sf_dir), AT, CONFIG), *SCORES)


@query()
def pq_rescore(spark, sf_dir):
    book, path = _codes(spark, sf_dir)
    return rounded(quantize.pq_rescored(spark.read.parquet(path), book, fx.query(spark, sf_dir), AT, CONFIG, factor=FACTOR), *SCORES)


# Lists and codes with given centres, the first rows, so that SQL can say the same.
GIVEN = 16


def _given(spark, sf_dir) -> np.ndarray:
    rows = fx.read(spark, sf_dir, "embeddings").where(F.col("vec_id") < GIVEN).orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], float)


#: In the floats of the search: |c|^2 - 2 x c orders as the distance does.
NEAREST = f"""G AS (SELECT id AS c, e AS ce FROM V WHERE id < {GIVEN}), D AS (SELECT id, e, c, list_dot_product(ce, ce) - 2 * list_dot_product(e, ce) AS d FROM V, G),
A AS (SELECT id, any_value(e) AS e, arg_min(c, d)::INTEGER AS cluster FROM D GROUP BY id)"""


@query(f"WITH {V}, {NEAREST} SELECT cluster, count(*) AS n FROM A GROUP BY cluster")
def ivf_list_sizes(spark, sf_dir):
    return ivf.assign(fx.vectors(spark, sf_dir), _given(spark, sf_dir)).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {V}, {NEAREST}, X AS (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS place FROM A) SELECT cluster, place::INTEGER AS place, round(avg(x), 6) AS mean FROM X GROUP BY 1, 2")
def ivf_centroid_update(spark, sf_dir):
    return rounded(ivf.centroid_update(ivf.assign(fx.vectors(spark, sf_dir), _given(spark, sf_dir))), "mean")


#: Eight parts of eight numbers, with the parts of the first rows as centres.
CODED = f"""G AS (SELECT id AS c, e AS ce FROM V WHERE id < {GIVEN}), M AS (SELECT unnest(range(8)) AS m),
D AS (SELECT V.id, m, c, list_sum(list_transform(range(8), lambda i: pow(e[m * 8 + i + 1] - ce[m * 8 + i + 1], 2))) AS d FROM V, G, M),
C AS (SELECT id, m, arg_min(c, d) AS code FROM D GROUP BY id, m)"""


def _given_book(spark, sf_dir) -> quantize.Codebook:
    return quantize.Codebook(np.ascontiguousarray(_given(spark, sf_dir).reshape(GIVEN, 8, 8).transpose(1, 0, 2)))


@query(f"WITH {V}, {CODED} SELECT id, string_agg(code::VARCHAR, ',' ORDER BY m) AS code FROM C GROUP BY id")
def pq_encode(spark, sf_dir):
    return quantize.encode(fx.vectors(spark, sf_dir), _given_book(spark, sf_dir)).select("id", F.array_join(F.transform("code", lambda c: c.cast("string")), ",").alias("code"))


@query(f"""WITH {V}, {Q}, {CODED}, T AS (SELECT m, c, list_sum(list_transform(range(8), lambda i: pow(q[m * 8 + i + 1] - ce[m * 8 + i + 1], 2))) AS d FROM G, M, Q),
S AS (SELECT C.id, sum(d) AS d FROM C JOIN T ON C.m = T.m AND code = c GROUP BY C.id),
N AS (SELECT C.id, sqrt(sum(list_sum(list_transform(range(8), lambda i: pow(ce[m * 8 + i + 1], 2))))) AS n FROM C JOIN G ON code = c GROUP BY C.id)
SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity, round(n, 6) AS decoded_norm FROM S JOIN N USING (id)""")
def pq_distances(spark, sf_dir):
    book = _given_book(spark, sf_dir)
    rows = quantize.encode(fx.vectors(spark, sf_dir), book)
    d = quantize.adc("code", book, fx.query(spark, sf_dir))
    return rounded(rows.select("id", d.alias("distance"), v.adc_similarity(d).alias("similarity"), v.norm(quantize.decode("code", book)).alias("decoded_norm")), "distance", "similarity", "decoded_norm")


@query(f"WITH G AS (SELECT vec_id AS c, embedding AS e FROM embeddings WHERE vec_id < {GIVEN}), M AS (SELECT unnest(range(8)) AS m) SELECT m::INTEGER AS m, c::INTEGER AS c, round(e[m * 8 + 1]::DOUBLE, 6) AS first FROM G, M")
def codebook_round_trip(spark, sf_dir):
    path = scratch_path(spark, "book")
    _given_book(spark, sf_dir).save(spark, path)
    back = quantize.Codebook.load(spark, path)
    rows = [(m, c, float(back.centres[m, c, 0])) for m in range(back.subspaces) for c in range(GIVEN)]
    return rounded(spark.createDataFrame(rows, "m int, c int, first double"), "first")


@query(f"WITH {V}, P AS (SELECT a.id AS id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS score FROM V a JOIN V b ON a.id <> b.id), R AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour))::INTEGER AS rank FROM P) SELECT id, rank, neighbour, round(score, 6) AS score FROM R WHERE rank <= 4")
def knn_graph(spark, sf_dir):
    return rounded(search.knn_graph(fx.vectors(spark, sf_dir), 4), "score")


@query("SELECT count(*) AS n_vectors, count(*) * 256 AS raw_bytes, count(*) * 8 AS pq_bytes, 32.0::DOUBLE AS ratio, ceil(1000000000 / count(*)) AS shards, 0.256::DOUBLE AS raw_tb, 0.008::DOUBLE AS pq_tb FROM embeddings")
def pq_memory(spark, sf_dir):
    n = fx.vectors(spark, sf_dir).count()
    goal = codec.scale_projection(n, 64, 8)
    return spark.createDataFrame([(n, n * 64 * 4, codec.pq_bytes(n, 8), codec.compression_ratio(64, 8), float(goal["shards"]), goal["raw_tb"], goal["pq_tb"])],
                                 "n_vectors long, raw_bytes long, pq_bytes long, ratio double, shards double, raw_tb double, pq_tb double")


# The engine: collections, logged writes, versions -----------------------------------------------------------

def _engine(spark, sf_dir) -> Engine:
    """A collection filled in two batches and compacted between them; then rows deleted, replaced and given edges."""
    def build(vectors, path):
        engine = Engine(spark, path)
        engine.create_collection("v", dim=64, temporal=CONFIG)
        rows = vectors.select(F.col("id").cast("string").alias("id"), "embedding", "payload", "created_at", "valid_from", "valid_until")
        number = F.col("id").cast("long")
        engine.upsert("v", rows.where(number % 2 == 0), AT)
        engine.add_edges("v", rows.select(F.col("id").alias("src"), ((number * 7 + 3) % 100).cast("string").alias("tgt"), F.lit("CAUSES").alias("type")))
        engine.compact("v")
        engine.upsert("v", rows.where(number % 2 == 1), AT)
        engine.upsert("v", rows.where(number % 10 == 4).withColumn("created_at", F.col("created_at") - DAY_MS), AT)
        engine.delete("v", ["1", "2", "no such id"])
        return engine

    return _written(spark, sf_dir, "engine", build)


def build_indexes(spark: SparkSession, sf_dir: str) -> None:
    """Writes the lists and codes that the index queries read, unless the session has them."""
    _lists(spark, sf_dir)
    _codes(spark, sf_dir)


ENGINE = f"X AS (SELECT id, e, label, shard, valid_until, CASE WHEN id % 10 = 4 THEN created_at - {DAY_MS} ELSE created_at END AS created_at FROM V WHERE id NOT IN (1, 2))"


@query(f"WITH {V}, {ENGINE} SELECT id::VARCHAR AS id, created_at, valid_until FROM X")
def engine_state(spark, sf_dir):
    return _engine(spark, sf_dir).vectors("v").select("id", "created_at", "valid_until")


@query(f"""WITH {V}, {ENGINE}, {Q}, S AS (SELECT id, {UNIT} AS sim, {TW} AS tw, 0.7 * ({UNIT}) + 0.3 * ({TW}) AS score FROM X, Q WHERE {LIVE})
SELECT (row_number() OVER (ORDER BY score DESC, id::VARCHAR))::INTEGER AS rank, id::VARCHAR AS id, round(score, 6) AS score, CASE WHEN (id * 7 + 3) % 100 IN (1, 2) THEN '' ELSE ((id * 7 + 3) % 100)::VARCHAR END AS causal_neighbors
FROM S ORDER BY rank LIMIT 10""")
def engine_search(spark, sf_dir):
    hits = _engine(spark, sf_dir).search("v", fx.query(spark, sf_dir), SearchOptions(mode="causal_expand", hops=1), AT)
    return rounded(hits.select("rank", "id", "score", graph.joined("causal_neighbors").alias("causal_neighbors")), "score")


@query(f"WITH {V} SELECT 'v' AS name, count(*) FILTER (id NOT IN (1, 2)) AS n_vectors, 4 AS n_shards, 64 AS dim, 'cosine' AS metric FROM V")
def engine_stats(spark, sf_dir):
    return _engine(spark, sf_dir).stats("v")


@query(f"WITH {V} SELECT id::VARCHAR AS src, ((id * 7 + 3) % 100)::VARCHAR AS tgt FROM V WHERE id NOT IN (1, 2) AND (id * 7 + 3) % 100 NOT IN (1, 2)")
def engine_edges(spark, sf_dir):
    return _engine(spark, sf_dir).edges("v").select("src", "tgt")


@query("SELECT unnest([100, 200, 300]) AS at, unnest([(SELECT count(*) FROM nation), (SELECT count(*) FROM nation) + 1, (SELECT count(*) FROM nation)]) AS n")
def table_versions(spark, sf_dir):
    tables, rows = Tables(spark, scratch_path(spark, "tables")), fx.read(spark, sf_dir, "nation").select("n_nationkey")
    tables.write("t", rows, at=100)
    tables.write("t", rows.unionAll(rows.limit(1)), at=200)
    tables.write("t", tables.read("t", at=150), at=300)
    counted = [tables.read("t", at=a).agg(F.lit(a).alias("at"), F.count("*").alias("n")) for a in (100, 200, 300)]
    return reduce(DataFrame.unionAll, counted)


@query(f"""WITH {V} SELECT unnest(['IDLE', 'MIGRATING', 'COMPLETE', 'FAILED']) AS phase, unnest([0, count(*), count(*), count(*)])::BIGINT AS total,
  unnest([0, count(*) FILTER (id % 5 <> 0), count(*) FILTER (id % 5 <> 0), 0])::BIGINT AS migrated, unnest([0, 0, count(*) FILTER (id % 5 = 0), 0])::BIGINT AS skipped,
  unnest([0, round(100.0 * count(*) FILTER (id % 5 <> 0) / count(*), 6), 100, 0])::DOUBLE AS pct FROM V""")
def drift_phases(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select("id", "embedding", "created_at")
    run = drift.Migration(rows, scratch_path(spark, "migration"))
    seen = [run.status()]
    run.start()
    run.add(rows.where("id % 5 <> 0").select("id", "embedding"))
    seen.append(run.status())
    run.finish()
    seen.append(run.status())
    other = drift.Migration(rows, scratch_path(spark, "migration"))
    other.start()
    other.abort()
    seen.append(other.status())
    return rounded(reduce(DataFrame.unionAll, seen), "pct")


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents""")
def doc_tokens(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.size(codec.tokenize(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT page_id, url LIKE 'http%' AND regexp_extract(url, '^https?://([^/:?#]+)', 1) NOT LIKE '%.local' AS allowed, regexp_extract(url, '^https?://([^/:?#]+)', 1) = 'a.example' AS listed FROM pages")
def callback_hosts(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", codec.host_allowed(F.col("url")).alias("allowed"), codec.host_allowed(F.col("url"), ("a.example",)).alias("listed"))


@query("SELECT o_orderkey AS segment_id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderpriority || o_orderstatus || o_orderkey END AS text, o_orderkey % 5 = 4 AS lost FROM orders")
def erasure_round_trip(spark, sf_dir):
    """Four data and two parity shards; as many are lost as the key modulo 5 says, the first ones at most two, or four in all."""
    text = F.concat("o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string"))
    shards = erasure.encode_segments(fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), text.cast("binary").alias("data")), 4, 2)
    n = F.col("segment_id") % 5
    left = shards.where(F.when(n == 4, F.col("shard") >= 4).when(n == 3, ~F.col("shard").isin(1, 4)).otherwise(F.col("shard") >= n))
    return erasure.decode_segments(left, 4, 2).select("segment_id", F.col("data").cast("string").alias("text"), F.col("error").isNotNull().alias("lost"))


@query(f"""WITH {V} SELECT 'exact' AS strategy, 'v' AS collection, count(*) AS n_rows, count(*) FILTER (({LIVE})) AS computed, 'search' AS span, '1706745599990000000' AS began FROM V""")
def trace_export(spark, sf_dir):
    one = trace.trace(fx.vectors(spark, sf_dir), None, fx.query(spark, sf_dir), AT, CONFIG, query_id="q", collection="v", latency_ms=10.0)
    one = stored(one, "trace")
    got = lambda path: F.get_json_object("value", path)
    log = trace.trace_json(one, "s", AT).select(got("$.strategy").alias("strategy"), got("$.collection").alias("collection"), got("$.n_rows").cast("long").alias("n_rows"), got("$.distance_computations").cast("long").alias("computed"))
    span = "$.resourceSpans[0].scopeSpans[0].spans[0]"
    return log.crossJoin(trace.otlp(one, "s", AT).select(got(f"{span}.name").alias("span"), got(f"{span}.startTimeUnixNano").alias("began")))  # one row each


@query("""SELECT unnest(['nodes_healthy', 'nodes_failed', 'durability_nines', 'p_data_loss_year', 'segments_at_risk', 'segments_scrubbed', 'failures']) AS metric, unnest([
  (SELECT count(*) FILTER (s_suppkey % 5 <> 0) FROM supplier)::DOUBLE, (SELECT count(*) FILTER (s_suppkey % 5 = 0) FROM supplier)::DOUBLE,
  (SELECT round(2 - log10(sum(exp(lgamma(15) - lgamma(i + 1) - lgamma(15 - i)) * pow(0.004, i) * pow(0.996, 14 - i))), 4) FROM range(5, 15) t(i)),
  0.0::DOUBLE, (SELECT count(*) FILTER (o_orderkey % 9 = 0) FROM orders)::DOUBLE, (SELECT count(*) FROM orders)::DOUBLE,
  (SELECT count(*) FROM (SELECT epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap > 86400000)::DOUBLE]) AS value""")
def health_metrics(spark, sf_dir):
    nodes = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 5 != 0).alias("healthy"))
    gauges = evaluate.health_gauges(evaluate.durability_report(nodes, 10, 4, 0.004), scrub_segments(spark, sf_dir), evaluate.heartbeat_gaps(_beats(spark, sf_dir), DAY_MS))
    return gauges.withColumn("value", F.round("value", 4))


@query(f"WITH {_batch_sql(3)} SELECT query_id, rank, id, round(score, 6) AS score FROM T")
def search_stream(spark, sf_dir):
    rows = fx.queries(spark, sf_dir).select("query_id", "embedding")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(_stream_parts(rows, 2))
    path = scratch_path(spark, "out")
    vectors = fx.vectors(spark, sf_dir)
    jobs.search_stream(stream, lambda batch: search.batch_search(vectors, batch, AT, CONFIG, SearchOptions(top_k=3)), path, scratch_path(spark, "checkpoint")).awaitTermination()
    return rounded(spark.read.parquet(path).select("query_id", "rank", "id", "score"), "score")


def _stream_parts(rows: DataFrame, parts: int) -> str:
    path = scratch_path(rows.sparkSession, "stream")
    rows.repartition(parts).write.mode("overwrite").parquet(path)
    return path


@query("SELECT id, lsn, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS op FROM (SELECT user_id AS id, event_id AS lsn, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def change_stream(spark, sf_dir):
    rows = fx.changes(spark, sf_dir).select("lsn", "id", "op")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(_stream_parts(rows, 4))
    out = jobs.collected(jobs.latest_changes(stream), scratch_path(spark, "out"), scratch_path(spark, "checkpoint"), "update")
    return writes.last_wins(out, "id", "batch").select("id", "lsn", "op")


def _requests(spark, sf_dir) -> DataFrame:
    return fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0).alias("at"), F.col("event_id").alias("request_id"))


RATE_LIMIT = """WITH RECURSIVE r AS (SELECT user_id AS client, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS seen, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b(client, n, request_id, seen, last, allowed, tokens) AS (SELECT client, n, request_id, seen, seen, true, 2.0::DOUBLE FROM r WHERE n = 1 UNION ALL
  SELECT client, n, request_id, seen, last, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM (
    SELECT r.client, r.n, r.request_id, r.seen, CASE WHEN tokens < 1 THEN r.seen ELSE last END AS last,
      CASE WHEN tokens < 1 THEN least(3.0::DOUBLE, tokens + greatest(0.0::DOUBLE, r.seen - last) * (1.0::DOUBLE / 86400)) ELSE tokens END AS t FROM b JOIN r ON r.client = b.client AND r.n = b.n + 1))
SELECT client, seen AS "at", request_id, allowed FROM b"""


@query(RATE_LIMIT)
def rate_limit_stream(spark, sf_dir):
    rows = _requests(spark, sf_dir)
    stream = spark.readStream.schema(rows.schema).parquet(_stream_parts(rows, 1))
    return jobs.collected(jobs.rate_limit(stream, 1 / 86_400, 3), scratch_path(spark, "out"), scratch_path(spark, "checkpoint"))


@query(RATE_LIMIT)
def rate_limit_table(spark, sf_dir):
    return jobs.rate_limit_batch(_requests(spark, sf_dir), 1 / 86_400, 3)
