"""Evaluations in which queries never meet all rows of their label."""

import pytest

from halflife.plans import catalogue


@pytest.mark.parametrize("name", ["eval_cohort", "eval_gold_rank", "eval_ndcg"])
def test_queries_do_not_meet_the_rows_of_their_label(spark, sf, name):
    """A window by query over rows joined on the label holds all pairs of a label."""
    seen = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalogue.QUERIES[name](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        todo = [plan]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                seen.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen and max(seen) <= 200  # ten queries with ten hits; 500 rows of ten labels make 10 x 50 pairs
