"""Functions and operators on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflife.engine import Engine
from halflife.functions import codec
from halflife.functions import temporal as t
from halflife.functions import vector as v
from halflife.operators import drift, erasure, evaluate, graph, ivf, quantize, search, writes
from halflife.schema import DAY_MS, AgentConfig, CollectionConfig, EngineError, SearchOptions, TemporalConfig
from halflife.sources import json_io
from halflife.sources.tables import Tables
from halflife.streaming import jobs

H = 7 * DAY_MS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows_of(spark, data):
    return spark.createDataFrame(data, "id string, embedding array<float>, payload map<string,string>, created_at long, valid_from long, valid_until long")


def test_decay_and_blend(spark):
    at = 10 * H
    for age, want in ((0, 1.0), (H, 0.5), (2 * H, 0.25), (30 * DAY_MS, 2 ** (-30 / 7)), (-H, 1.0)):
        assert one(spark, t.temporal_weight(F.lit(at - age), at, H)) == pytest.approx(want)
    assert one(spark, t.blend(F.lit(0.8), F.lit(1.0), 0.3)) == pytest.approx(0.86)
    reason = one(spark, t.staleness_reason(F.lit(0.125), F.lit(at - 3 * H), at, TemporalConfig(half_life_ms=H, staleness_threshold=0.4)))
    assert reason == "Vector is 21 days old (temporal_score=0.125)"


def test_metrics(spark):
    cols = {k: F.array(*[F.lit(float(x)) for x in a]) for k, a in {"x": (1, 0), "y": (0, 1), "z": (0, 0), "p": (3, 4)}.items()}
    assert one(spark, v.cosine(cols["x"], cols["x"])) == 1 and one(spark, v.cosine(cols["x"], [0.0, 1.0])) == 0
    assert one(spark, v.cosine(cols["x"], cols["z"])) == 0 and one(spark, v.l2_distance(cols["z"], cols["p"])) == 5
    assert one(spark, v.similarity(cols["z"], cols["p"], "l2")) == pytest.approx(1 / 6)
    assert one(spark, v.similarity(cols["x"], [-1.0, 0.0])) == 0 and one(spark, v.normalised(cols["p"])) == [0.6, 0.8] and one(spark, v.normalised(cols["z"])) == [0, 0]
    with pytest.raises(EngineError):
        v.similarity("a", "b", "manhattan")


def test_validity_ends_belong(spark):
    f = lambda at, lo, hi: one(spark, t.is_valid_at(at, F.lit(lo).cast("long"), F.lit(hi).cast("long")))
    assert f(5, 5, 5) and f(5, None, None) and not f(4, 5, None) and not f(6, None, 5)


def test_payload_filter(spark):
    p = F.create_map(F.lit("k"), F.lit("v=w"))
    assert one(spark, codec.payload_filter("k=v=w", p)) and one(spark, codec.payload_filter("", p)) and one(spark, codec.payload_filter("abc", p))
    assert not one(spark, codec.payload_filter("q=1", p))


def test_codes_and_hashes(spark):
    assert one(spark, codec.edge_code(F.lit("SUPPORTS"))) == 5 and one(spark, codec.edge_name(F.lit(1))) == "CONTRADICTS"
    with pytest.raises(Exception, match="unknown edge type"):
        one(spark, codec.edge_code(F.lit("NOPE")))
    assert codec.fnv1a(b"") == 0xCBF29CE484222325 and codec.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    ids = spark.createDataFrame([(f"vec_{i}",) for i in range(100)], "id string")
    got = {r["id"]: r["s"] for r in ids.select("id", codec.shard_of("id", 4).alias("s")).collect()}
    assert all(s == codec.fnv1a(i.encode()) % 4 for i, s in got.items()) and set(got.values()) == {0, 1, 2, 3}


def test_durability():
    assert codec.durability_nines(10, 4, 0.004) == pytest.approx(10.70, abs=0.01)
    assert codec.pq_bytes(10**9, 96) == 96e9 and codec.compression_ratio(768, 96) == 32


def test_hosts(spark):
    ok = lambda u, a=(): one(spark, codec.host_allowed(F.lit(u), a))
    assert ok("https://a.example.com/x") and not ok("http://127.0.0.1/") and not ok("ftp://a.example.com") and not ok("http://172.16.1.1/") and ok("http://172.200.1.1/")
    assert not ok("https://b.example.com", ("a.example.com",))


def test_search_order_filter_and_errors(spark):
    now = 1_000_000
    data = rows_of(spark, [("old", [1.0, 0.0], {"type": "doc"}, now - 5000, 0, None), ("new", [1.0, 0.0], {"type": "news"}, now, 0, None), ("off", [0.0, 1.0], {"type": "doc"}, now, 0, None), ("late", [1.0, 0.0], {}, now, now + 1, None)])
    config = TemporalConfig(half_life_ms=1000, staleness_threshold=0.2)
    hits = search.search(data, [1.0, 0.0], now, config).collect()
    assert [h["id"] for h in hits] == ["new", "old", "off"] and hits[1]["staleness_warning"] and not hits[0]["staleness_warning"]
    assert [h["id"] for h in search.search(data, [1.0, 0.0], now, config, SearchOptions(filter="type=doc", include_staleness=False)).collect()] == ["old", "off"]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<double>")
    both = search.batch_search(data, q, now, config, SearchOptions(top_k=1)).collect()
    assert {(r["query_id"], r["id"]) for r in both} == {(1, "new"), (2, "off")}
    assert search.batch_search(data, q.limit(0), now, config).count() == 0
    with pytest.raises(Exception, match="dimension"):
        search.batch_search(data, spark.createDataFrame([(1, [1.0])], q.schema), now, config).collect()
    assert [r["id"] for r in search.distances(data, [0.0, 1.0], 1).collect()] == ["off"]
    assert search.choose_strategy(10) == "exact" and search.choose_strategy(10**9, 0.9) == "pq"


def test_batch_equals_single(spark):
    rng = np.random.default_rng(0)
    data = rows_of(spark, [(f"v{i:03}", [float(x) for x in rng.normal(size=8)], {}, 1000 + i, 0, None) for i in range(60)])
    q = [float(x) for x in rng.normal(size=8)]
    for metric in ("cosine", "l2", "dot"):
        o = SearchOptions(top_k=7, metric=metric)
        a = [r["id"] for r in search.search(data, q, 2000, TemporalConfig(half_life_ms=100), o).collect()]
        b = search.batch_search(data, spark.createDataFrame([(0, q)], "query_id int, embedding array<double>"), 2000, TemporalConfig(half_life_ms=100), o)
        assert a == [r["id"] for r in b.orderBy("rank").collect()]
        s = search.shard_search(data, q, 2000, TemporalConfig(half_life_ms=100), o, codec.shard_of("id", 4))
        assert a == [r["id"] for r in s.orderBy("rank").collect()]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, 1.0, 0) for a, b, k in rows], "src string, tgt string, type string, weight float, created_at long")


def test_graph(spark):
    e = edges(spark, [("a", "b", "CAUSES"), ("b", "c", "CAUSES"), ("c", "d", "CAUSES"), ("d", "a", "CAUSES"), ("f1", "f2", "CONTRADICTS"), ("f1", "f3", "CONTRADICTS")])
    near = lambda n, h: {r["node"] for r in graph.neighbours(e, n, h).collect()}
    assert near("a", 1) == {"b"} and near("a", 3) == {"b", "c", "d"} and near("a", 9) == {"b", "c", "d"} and near("zz", 2) == set()
    assert {r["node"] for r in graph.contradictions(e, "f1").collect()} == {"f2", "f3"} and {r["node"] for r in graph.contradictions(e, "f2", "in").collect()} == {"f1"}
    assert tuple(graph.path_exists(e, "a", "d").first()) == (True, 3) and graph.path_exists(e, "a", "f1").first()[0] is False
    assert graph.expand(e, spark.createDataFrame([("a",)], "id string"), 2).count() == 3
    assert tuple(graph.counts(graph.remove_edges(e, "a", "b")).first()) == (5, 7)
    assert graph.add_edges(e, e.limit(1).select("src", "tgt", "type")).count() == 7
    with pytest.raises(Exception, match="unknown edge type"):
        graph.add_edges(e, edges(spark, [("a", "b", "HATES")])).collect()


def test_replay_and_checksums(spark):
    log = spark.createDataFrame([(1, "UPSERT", "a", 1.0), (2, "UPSERT", "b", 2.0), (3, "DELETE", "a", None), (10, "UPSERT", "b", 3.0)], "lsn long, op string, id string, value double")
    assert [tuple(r) for r in writes.replay(log).select("id", "value").collect()] == [("b", 3.0)]
    signed = writes.with_checksum(log)
    broken = signed.withColumn("value", F.when(F.col("lsn") == 2, 9.0).otherwise(F.col("value")))
    assert writes.verified(signed).count() == 4 and writes.verified(broken).count() == 3
    with pytest.raises(Exception, match="bad checksum at lsn 2"):
        writes.verified(broken, halt=True).collect()


def test_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    x[40:60] = x[:20] + rng.normal(size=(20, 6)) * 0.05
    data = rows_of(spark, [(f"v{i:03}", [float(a) for a in x[i]], {}, i % 7, 0, None) for i in range(80)])
    u = np.array([r["embedding"] for r in data.orderBy("id").collect()], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for limit in (0.8, 0.95, 0.99):
        want = {f"v{j:03}" for j in range(80) if not any((i % 7, i) < (j % 7, j) and (u[i] @ u[j] + 1) / 2 >= limit for i in range(80))}
        assert {r["id"] for r in writes.dedup(data, limit).select("id").collect()} == want


def test_quantizer_and_lists(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rows_of(spark, [(f"v{i:03}", [float(a) for a in rng.uniform(-1, 1, 16)], {}, 0, 0, None) for i in range(200)])
    book = quantize.train(data, 4, 32)
    coded = quantize.encode(data, book).select("id", "embedding", "code", quantize.decode("code", book).alias("near"), quantize.adc("code", book, [0.0] * 16).alias("d"))
    for r in coded.limit(20).collect():
        x = np.array(r["embedding"], float)
        assert list(book.encode(x[None])[0]) == r["code"] and r["d"] == pytest.approx(sum(a * a for a in r["near"]), abs=1e-9)
    book.save(spark, str(tmp_path / "book"))
    assert np.allclose(quantize.Codebook.load(spark, str(tmp_path / "book")).centres, book.centres)
    centres = ivf.train(data, 8)
    assigned = ivf.assign(data, centres)
    q = [0.1] * 16
    full = [r["id"] for r in search.search(data, q, 0, TemporalConfig()).collect()]
    assert [r["id"] for r in ivf.ivf_search(assigned, centres, q, 8, 0, TemporalConfig()).collect()] == full
    assert ivf.ivf_distances(assigned, centres, q, 3, 5).count() == 5 and ivf.centroid_update(assigned).count() == 8 * 16
    with pytest.raises(EngineError):
        quantize.train(data, 5)


def test_evaluation(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id int, id string, rank int")
    queries = spark.createDataFrame([(1, "b"), (2, "y"), (3, "z")], "query_id int, gold_id string")
    ranks = evaluate.gold_ranks(found, queries, 10)
    assert {r["query_id"]: r["gold_rank"] for r in ranks.collect()} == {1: 2, 2: 11, 3: 11}
    s = evaluate.gold_summary(ranks, spark.createDataFrame([(1, "a")], "query_id int, stale_id string")).first()
    assert s["gold_at_1"] == 0 and s["stale_at_1"] == pytest.approx(1 / 3) and s["mean_gold_rank"] == 8 and s["median_gold_rank"] == 11 and s["empty_rate"] == pytest.approx(1 / 3)
    rel = spark.createDataFrame([(1, "b", 3.0), (1, "a", 1.0)], "query_id int, id string, rel double")
    want = (1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3))
    assert evaluate.ndcg(found, rel).first()["ndcg"] == pytest.approx(want)


def test_token_bucket_refills_when_empty_only():
    assert jobs.token_bucket([0, 0, 0, 0.5, 1.0, 1.0], 1, 2)[0] == [True, True, False, False, True, False]


def test_procrustes():
    rng = np.random.default_rng(0)
    turn, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    old = rng.normal(size=(40, 5))
    assert np.allclose(old @ drift.procrustes(old, old @ turn), old @ turn)


def test_json(spark):
    lines = spark.createDataFrame([('{"id":"a","embedding":[1,2],"ttl_seconds":10,"created_at":5,"edges":[{"target_id":"b","type":"CAUSES"}]}',), ('{"id":"b"}',), ("no json",)], "value string")
    r = json_io.vectors_from_json(lines, 99)
    assert [(x["id"], x["valid_from"], x["valid_until"]) for x in r.collect()] == [("a", 5, 10_005)] and json_io.errors(lines).count() == 2
    assert [tuple(x)[:4] for x in json_io.inline_edges(r).collect()] == [("a", "b", "CAUSES", 1.0)]
    assert json_io.envelope(spark.createDataFrame([(1,)], "a int")).first()[0] == '{"status":"ok","data":[{"a":1}]}'


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create_collection("docs", dim=2, temporal=TemporalConfig(half_life_ms=1000))
    with pytest.raises(EngineError):
        e.create_collection("docs", dim=2)
    new = spark.createDataFrame([("a", [1.0, 0.0], {"k": "v"}, 5), ("b", [0.0, 1.0], {}, 6)], "id string, embedding array<float>, payload map<string,string>, created_at long")
    e.upsert("docs", new, now=10)
    e.add_edges("docs", edges(spark, [("a", "b", "CONTRADICTS")]))
    hit = e.search("docs", [1.0, 0.0], SearchOptions(top_k=1, mode="contradiction_check"), at=10).first()
    assert hit["id"] == "a" and hit["contradicted_by"] == ["b"]
    assert len(e.trace("docs", [1.0, 0.0], at=10).first()["contradiction_alerts"]) == 1
    again = Engine(spark, f"file://{tmp_path}/db")  # recovers from the folder
    assert again.config("docs").temporal.half_life_ms == 1000 and again.vectors("docs").count() == 2
    again.set_agent("docs", AgentConfig(enabled=True, dedup_threshold=0.99))
    again.upsert("docs", spark.createDataFrame([("c", [1.0, 0.001], {}, 7)], new.schema), now=10)
    assert again.vectors("docs").count() == 2
    with pytest.raises(Exception, match="dimension 2 expected"):
        again.upsert("docs", spark.createDataFrame([("d", [1.0], {}, 7)], new.schema), now=10)
    with pytest.raises(EngineError):
        again.search("docs", [1.0])
    status = again.migrate("docs", spark.createDataFrame([("a", [0.0, 1.0])], "id string, embedding array<float>")).first()
    assert (status["migrated"], status["skipped"], status["pct"]) == (1, 1, 100.0)
    assert again.delete("docs", ["a", "nope"]) == 1 and again.edges("docs").count() == 0
    again.drop_collection("docs")
    assert not Engine(spark, f"file://{tmp_path}/db").exists("docs")


def test_engine_replays_its_log(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create_collection("c", dim=2, temporal=TemporalConfig(half_life_ms=1000))
    kind = "id string, embedding array<float>, payload map<string,string>, created_at long"
    batch = lambda *rows: spark.createDataFrame([(i, v, {}, at) for i, v, at in rows], kind)
    e.upsert("c", batch(("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2)), now=10)
    e.add_edges("c", edges(spark, [("a", "b", "CAUSES"), ("b", "a", "CAUSES")]))
    e.upsert("c", batch(("a", [0.5, 0.5], 3), ("c", [1.0, 1.0], 4)), now=10)
    assert e.delete("c", ["b"]) == 1
    state = lambda x: ({(r["id"], r["created_at"]) for r in x.vectors("c").collect()}, x.edges("c").count())
    assert state(e) == ({("a", 3), ("c", 4)}, 0) and e.tables.read("c").count() == 0  # nothing but the log was written
    again = Engine(spark, f"file://{tmp_path}/db")
    assert state(again) == state(e)
    again.upsert("c", batch(("b", [0.0, 1.0], 9)), now=10)
    again.add_edges("c", edges(spark, [("c", "b", "CAUSES")]))
    before = state(again)
    assert before == ({("a", 3), ("b", 9), ("c", 4)}, 1)
    again.compact("c")
    assert state(again) == before and again.tables.read("c").count() == 3 and not again.tables.log_batches("c", again.tables.current("c")["version"])
    at = int(again.tables.current("c")["created_at"])
    assert again.purge("c", 0) == 0 and again.delete("c", ["a"]) == 1
    again.restore("c", at)
    assert state(again)[0] == before[0]
    assert again.prune("c", keep=1) > 0 and state(again)[0] == before[0]
    with pytest.raises(EngineError):
        again.vectors("c", 5)
    again.set_agent("c", AgentConfig(enabled=True, ttl_seconds=7, dedup_threshold=0.9, cross_agent_readable=("x",)))
    assert Engine(spark, f"file://{tmp_path}/db").config("c").agent == AgentConfig(enabled=True, ttl_seconds=7, dedup_threshold=0.9, cross_agent_readable=("x",))


def test_engine_follows_its_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create_collection("c", dim=8, index_type="ivf", temporal=TemporalConfig(half_life_ms=1000))
    rows = rows_of(spark, [(f"v{i:03}", [float(x) for x in rng.normal(size=8)], {"k": str(i % 3)}, 0, 0, None) for i in range(200)])
    q = [float(x) for x in rng.normal(size=8)]
    e.upsert("c", rows, now=0)
    assert e.candidates("c", q)[0] == "exact"  # no index yet
    e.build_index("c", n_lists=8)
    full = [r["id"] for r in e.search("c", q, at=0, strategy="exact").collect()]
    assert e.candidates("c", q, n_probe=2)[1].count() < 200 and [r["id"] for r in e.search("c", q, at=0, n_probe=8).collect()] == full
    assert len(set(full) & {r["id"] for r in e.search("c", q, at=0).collect()}) >= 8
    assert e.candidates("c", q, "pq", n_probe=8)[1].count() == 200 and [r["id"] for r in e.search("c", q, at=0, strategy="pq", n_probe=8).collect()] == full
    assert e.candidates("c", q, "auto")[0] == "exact"
    # What the log says counts at once.
    e.upsert("c", rows_of(spark, [("new", q, {}, 0, 0, None), (full[0], [-x for x in q], {}, 0, 0, None)]), now=0)
    e.delete("c", [full[1]])
    for strategy in ("ivf", "pq"):
        hits = [r["id"] for r in e.search("c", q, at=0, strategy=strategy, n_probe=8).collect()]
        assert hits[0] == "new" and hits[1:9] == full[2:10]
        batch = e.batch_search("c", spark.createDataFrame([(1, q)], "query_id int, embedding array<double>"), at=0, strategy=strategy, n_probe=8)
        assert [r["id"] for r in batch.orderBy("rank").collect()] == hits
    e.compact("c")
    assert e.candidates("c", q)[0] == "exact"  # the index is older than the table
    with pytest.raises(EngineError):
        e.search("c", q, strategy="tree")


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = rows_of(spark, [(f"v{i:03}", [float(x) for x in rng.normal(size=4)], {}, i, 0, None) for i in range(90)])
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(25)], "query_id int, embedding array<double>")
    rows = lambda: sorted(map(tuple, search.batch_search(data, q, 100, TemporalConfig(half_life_ms=50), SearchOptions(top_k=6)).select("query_id", "rank", "id").collect()))
    whole = rows()
    monkeypatch.setattr(search, "BROADCAST_FLOATS", 16)  # four queries a block
    monkeypatch.setattr(search, "BLOCK_ROWS", 20)
    assert rows() == whole and len(whole) == 150


def test_near_pairs_in_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=8) * 3 + rng.normal(size=(25, 8)) * 0.3 for _ in range(4)] + [np.zeros((2, 8))])
    data = rows_of(spark, [(f"v{i:03}", [float(a) for a in x[i]], {}, None if i == 3 else i % 7, 0, None) for i in range(len(x))])
    u = np.array([r["embedding"] for r in data.orderBy("id").collect()], float)
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-12)[:, None]
    key = lambda i: (i != 3, i % 7, i) if i != 3 else (False, 0, i)
    want = lambda limit: {(f"v{i:03}", f"v{j:03}") for i in range(len(x)) for j in range(len(x)) if key(i) < key(j) and (u[i] @ u[j] + 1) / 2 >= limit}
    monkeypatch.setattr(writes, "BLOCK", 10)
    for limit in (0.45, 0.9, 0.98):
        got = [(r["a"], r["b"]) for r in writes.near_pairs(data, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want(limit)
    late = {r["id"] for r in writes.later_rows(data, 0.9, F.col("id") >= "v050").collect()}
    assert late == {b for _, b in want(0.9) if b >= "v050"}


def test_drift_phases(spark, tmp_path):
    run = drift.Migration(rows_of(spark, [("a", [1.0], {}, 0, 0, None), ("b", [2.0], {}, 0, 0, None)]), f"file://{tmp_path}/shadow")
    with pytest.raises(EngineError):
        run.finish()
    run.start()
    run.add(spark.createDataFrame([("a", [9.0])], "id string, embedding array<float>"))
    assert tuple(run.status().first()) == ("MIGRATING", 2, 1, 0, 50.0)
    assert {(r["id"], r["embedding"][0], r["migrated"]) for r in run.finish().collect()} == {("a", 9.0, True), ("b", 2.0, False)}
    assert tuple(run.status().first()) == ("COMPLETE", 2, 1, 1, 100.0)
    with pytest.raises(EngineError):
        run.abort()


def test_engine_migrates_in_steps(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.create_collection("c", dim=1)
    kind = "id string, embedding array<float>, created_at long, new_embedding array<float>"
    e.upsert("c", spark.createDataFrame([("a", [1.0], 0, None), ("b", [2.0], 0, None)], kind), now=0)
    with pytest.raises(EngineError):
        e.migration_status("c")
    e.start_migration("c")
    with pytest.raises(EngineError):
        e.start_migration("c")
    e.add_migrated("c", spark.createDataFrame([("a", [9.0])], "id string, embedding array<float>"))
    e.upsert("c", spark.createDataFrame([("d", [4.0], 0, [8.0])], kind), now=0)  # written to both
    assert tuple(e.migration_status("c").first())[:3] == ("MIGRATING", 3, 2)
    assert tuple(e.finish_migration("c").first()) == ("COMPLETE", 3, 2, 1, 100.0)
    assert {(r["id"], r["embedding"][0]) for r in e.vectors("c").collect()} == {("a", 9.0), ("b", 2.0), ("d", 8.0)}
    e.start_migration("c")
    e.abort_migration("c")
    assert e.migration_status("c").first()["phase"] == "FAILED" and e.vectors("c").count() == 3


def test_beats_without_ids(spark):
    beats = spark.createDataFrame([("n", 0), ("n", 50), ("n", 50), ("m", 5)], "node_id string, at long")
    assert [tuple(r) for r in evaluate.heartbeat_gaps(beats, 20).collect()] == [("n", 20, 50, 50)]


def test_many_manifests(spark, tmp_path, monkeypatch):
    from halflife.sources import tables as module

    monkeypatch.setattr(module, "MANIFEST_FILES", 2)
    tables = Tables(spark, f"file://{tmp_path}/t")
    for n in range(4):
        tables.write("x", spark.range(n), at=n * 100)
    assert [tables.read("x", at=n * 100).count() for n in range(4)] == [0, 1, 2, 3] and tables.manifests().count() == 4
    assert tables.prune("x", keep=1) == 3 and tables.read("x").count() == 3
    with pytest.raises(EngineError):
        tables.read("x", at=150)


def test_tables_in_time(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    for n, at in ((1, 100), (2, 200), (3, 300)):
        tables.write("x", spark.range(n), at=at)
    assert tables.read("x").count() == 3 and tables.read("x", at=250).count() == 2
    tables.restore("x", 150)
    assert tables.read("x").count() == 1 and tables.snapshots("x").count() == 1
    assert tables.prune("x", keep=2) == 3
    change = spark.createDataFrame([(1, "UPSERT", 5, ("a", [1.0], {}, 1, 1, None), None, None), (2, "ADD_EDGE", 6, None, None, ("a", "b", "CAUSES", 1.0, 6)), (3, "DELETE", 7, None, "a", None)],
                                   "lsn long, op string, ts long, vec struct<id:string,embedding:array<float>,payload:map<string,string>,created_at:long,valid_from:long,valid_until:long>, del_id string, edge struct<src:string,tgt:string,type:string,weight:float,created_at:long>")
    tables.append_changes("x", change.where("lsn < 3"))
    assert [d.count() for d in tables.replayed("x")] == [1, 1]
    tables.append_changes("x", change.where("lsn = 3"))
    assert [d.count() for d in tables.replayed("x")] == [0, 0]


def test_checks():
    for bad in (lambda: CollectionConfig("x", metric="no"), lambda: SearchOptions(mode="no"), lambda: TemporalConfig(blend=2)):
        with pytest.raises(EngineError):
            bad()
    assert CollectionConfig("x", n_shards=0).n_shards == 4


def test_erasure():
    """Products of the field by shift and reduce; every loss of up to two shards of six; too few shards."""
    def slow(a, b):
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = a << 1 ^ (0x11D if a & 128 else 0)
            b >>= 1
        return out

    rng = np.random.default_rng(42)
    a, b = rng.integers(0, 256, (2, 3_000))
    assert erasure.times(a, b).tolist() == [slow(int(x), int(y)) for x, y in zip(a, b, strict=True)]
    assert all(erasure.times(x, erasure.inverse(x)) == 1 for x in range(1, 256)) and erasure.to_power(3, 2) == 5 and erasure.to_power(0, 0) == 1
    data = rng.integers(0, 256, 1_001).astype(np.uint8).tobytes()
    shards = dict(enumerate(erasure.encode(data, 4, 2)))
    assert len(shards) == 6 and b"".join(shards[i] for i in range(4))[:1_001] == data
    for x in range(6):
        for y in range(6):
            assert erasure.decode({i: s for i, s in shards.items() if i not in (x, y)}, 4, 2, len(data)) == data
    with pytest.raises(EngineError):
        erasure.decode({0: b"a", 1: b"b", 2: b"c"}, 4, 2, 4)
    large = erasure.encode(data, 10, 4)
    assert erasure.decode({i: s for i, s in enumerate(large) if i not in (0, 2, 7, 11)}, 10, 4, len(data)) == data
    assert erasure.decode(dict(enumerate(erasure.encode(b"", 4, 2))), 4, 2, 0) == b""
