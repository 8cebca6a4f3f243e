"""The query set of the batch searches and evaluations grows with the table."""

import pytest
from oracle import connect, duck_rows, spark_rows

from halflife.plans import catalogue


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_all_queries_are_searched(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert n > 5
    assert catalogue.QUERIES["batch_topk"](spark, sf_dir).select("query_id").distinct().count() == n
    assert catalogue.QUERIES["eval_recall"](spark, sf_dir).first()["n_queries"] == n


def test_gold_rank_without_cross_join(spark):
    sf_dir = "/root/testdata/sf0.1"
    df = catalogue.QUERIES["eval_gold_rank"](spark, sf_dir)
    assert "CartesianProduct" not in (plan := df._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    assert spark_rows(df) == duck_rows(connect(sf_dir), catalogue.SQL["eval_gold_rank"])
