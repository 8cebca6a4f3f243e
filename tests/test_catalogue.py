"""Every query with SQL agrees with DuckDB; the others return rows."""

import pytest
from oracle import connect, duck_rows, spark_rows

import __spark_entry__ as entry
from halflife.operators import ivf
from halflife.plans import catalogue
from halflife.plans import fixtures as fx


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf, con, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == duck_rows(con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_returns_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_indexes(spark, sf_dir):
    """Over all rows whose id is divisible by 50, against the exact search."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").count()
    got = [*catalogue.ivf_recall(spark, sf_dir).collect(), *catalogue.pq_recall(spark, sf_dir).collect()]
    assert len(got) == 3 and all(r["recall"] >= 0.9 and r["n_queries"] == n for r in got), got


def test_lists_prune_files(spark, sf):
    lists = catalogue._lists(spark, sf)
    plan = ivf.probe(lists.rows(spark), lists.centres, fx.query(spark, sf), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))


def test_plans(spark, sf):
    plan = catalogue.flat_topk_blend(spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "SortMergeJoin" not in plan
    scan = catalogue.shard_sizes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint>" in scan
