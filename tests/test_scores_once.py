"""Scores made of regular expressions are made once a row, whatever is asked of them."""

from conftest import SF

from siftmill.operators.ordered import counted
from siftmill.plans import catalog
from siftmill.plans import views as V


def rules_in(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


def test_counting_scores_tries_each_rule_once(spark):
    assert rules_in(counted(V.preds(spark, SF), [], V.F.col("p_safe"))) == len(V.RULES)


def test_counting_leaves_out_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("b", None)], "k string, x double")
    assert [tuple(r) for r in counted(df, ["k"], V.F.col("x")).collect()] == [("a", 1.0, 2)]


def test_models_read_scores_that_are_made(spark):
    assert rules_in(catalog._models(spark, SF)[0]) == 0
