"""The registered queries agree with their SQL, and the pipeline with its stages' meaning."""

import collections

import pytest
from oracle import connect, duck_rows, spark_rows

import corpus_pipeline
from halflife.llm import decontam, jaccard, quality
from halflife.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(connect(sf), ORACLE_SQL[name])


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


def test_native_plans(spark, sf):
    for name in ("op2_license_scan", "op6_mix_sources", "op7_decontaminate", "op10_line_dedup"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mix_sources":
            assert docs.columns == columns
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    forest = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), quality.labels(spark, sf))
    good = {r["doc_id"] for r in quality.assess(spark.read.parquet(f"{sf}/documents.parquet"), forest).where("quality.kept").select("row.doc_id").collect()}
    assert set(seen["quality_rules"]) == good and set(seen["line_dedup"]) == good
    for i, r in seen["line_dedup"].items():
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split("\n")) <= set(source[i]["text"].split("\n"))
    after = spark.read.parquet(str(tmp_path / "line_dedup"))
    groups = collections.defaultdict(set)
    for r in jaccard.jaccard_components(after, 5, 80).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert set(seen["near_duplicates"]) == {min(g) for g in groups.values()}
    gone = {r["doc_id"] for r in decontam.leaks(spark.read.parquet(str(tmp_path / "near_duplicates")), decontam.benchmark(spark, sf)).collect()}
    assert set(seen["decontaminate"]) == set(seen["near_duplicates"]) - gone
    assert set(seen["mix_sources"]) <= set(seen["decontaminate"]) and all(r["copies"] in (1, 2) for r in seen["mix_sources"].values())
    run = {(r["doc_id"], r["copies"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert run == {(i, r["copies"]) for i, r in seen["mix_sources"].items()}


#: Names that the operators use themselves, or used to.
CLASHES = ("cuts", "hash", "_hash", "_source", "_salt", "salt", "_null", "no_text", "_quality", "quality", "row_", "kept", "rest", "copies", "text_hash", "batch", "bucket", "positions", "doc", "good", "target")


@pytest.fixture
def clashing(docs_of):
    """A table of (doc_id, text) or (doc_id, text, source) rows with more columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    return lambda rows: docs_of(rows).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def own_columns(before, after):
    """Nothing of the table's own columns is lost or changed."""
    return before.columns == after.columns and all(r[c] == f"own {c}" for r in after.collect() for c in CLASHES)


GOOD = " ".join(f"the river {i} runs past stone number {i * 7} and every boat of town {i % 13} waits for rain." for i in range(12))


def test_quality_stage_on_odd_rows(spark, sf, clashing, odd_rows):
    docs = clashing([*odd_rows, (50, GOOD), (50, GOOD), (None, GOOD)])
    out = stage("quality_rules")(spark, docs, sf)
    kept = texts(out)
    assert own_columns(docs, out) and all(len((t or "").split()) >= 50 for _, t in kept)
    assert len([1 for _, t in kept if t == GOOD]) in (0, 3)  # repeated rows, with an id or none, share their fate
    assert stage("quality_rules")(spark, clashing([]), sf).count() == 0


def test_line_stage_on_odd_rows(spark, sf, clashing, odd_rows):
    line = "this line is long enough to count as a repeated line of text"
    rows = [*odd_rows, *((i, f"{i}\n{line}\nend") for i in range(60, 66))]
    docs = clashing(rows)
    out = stage("line_dedup")(spark, docs, sf)
    assert own_columns(docs, out)
    # 3, 4, 4, 5, 7 and 60 to 65 hold the line; 65 keeps it. 6 holds it too, with spaces around.
    lost = {3, 4, 5, 6, 7, 60, 61, 62, 63, 64}
    want = [(i, t if i not in lost else "\n".join(x for x in t.split("\n") if x.strip().lower() != line)) for i, t in rows]
    assert texts(out) == sorted(want, key=repr)
    assert {r["doc_id"]: r["n_chars"] for r in stage("line_dedup")(spark, docs.withColumnRenamed("size", "n_chars"), sf).collect()}[60] == len("60\nend")
    assert stage("line_dedup")(spark, clashing([]), sf).count() == 0


def test_near_stage_on_odd_rows(spark, sf, clashing, odd_rows):
    docs = clashing([*odd_rows, (50, GOOD), (51, GOOD), (51, GOOD), (51, "another text of this id"), (None, GOOD)])
    out = stage("near_duplicates")(spark, docs, sf)
    got = texts(out)
    assert own_columns(docs, out)
    # 8 and 9, 3 and 4 and 7, 11 and 12, 50 and 51 are alike; null texts and rows without id stay.
    ids = collections.Counter(i for i, _ in got)
    assert ids[8] == 1 and ids[9] == 0 and ids[3] == 1 and ids[4] == 0 and ids[7] == 0 and ids[11] == 1 and ids[12] == 0
    assert ids[50] == 1 and (51, "another text of this id") in got and (51, GOOD) not in got and (None, GOOD) in got and (0, None) in got and (1, "") in got
    assert stage("near_duplicates")(spark, clashing([]), sf).count() == 0


def test_decontaminate_stage_on_odd_rows(spark, sf, clashing, odd_rows):
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r["text"].split()) > 12)
    rows = [*odd_rows, (50, f"before it {item} after it"), (50, f"before it {item} after it"), (51, "clean"), (51, item), (None, item)]
    docs = clashing(rows)
    out = stage("decontaminate")(spark, docs, sf)
    assert own_columns(docs, out)
    assert texts(out) == sorted([*odd_rows, (51, "clean")], key=repr)
    assert stage("decontaminate")(spark, clashing([]), sf).count() == 0


def test_mix_stage_on_odd_rows(spark, sf, clashing, odd_rows):
    rows = [(i, t, None if n % 3 == 0 else f"s{n % 3}") for n, (i, t) in enumerate(odd_rows)]
    docs = clashing(rows)
    out = stage("mix_sources")(spark, docs, sf)
    assert out.columns == [*[c for c in docs.columns if c != "copies"], "copies"]
    got = out.collect()
    assert all(r["copies"] in (1, 2) and all(r[c] == f"own {c}" for c in CLASHES if c != "copies") for r in got)
    assert {(r["doc_id"], r["text"]) for r in got} <= set(odd_rows)
    again = stage("mix_sources")(spark, docs, sf).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert stage("mix_sources")(spark, clashing([]), sf).count() == 0


def test_pipeline_on_odd_rows(spark, sf, tmp_path, clashing, odd_rows):
    for n, rows in enumerate((odd_rows, [])):
        docs = clashing(rows)
        for name, run in corpus_pipeline.STAGES[1:]:  # the first would reject nearly all of these
            run(spark, docs, sf).write.parquet(str(tmp_path / f"{n}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{name}"))


@pytest.mark.parametrize("name", ["op2_license_scan", "op10_line_dedup"])
def test_without_ansi(spark, sf, name):
    """size(null) is -1 then."""
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(connect(sf), ORACLE_SQL[name])
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
