"""Physical-plan properties that must hold for the registered queries."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FITTED = {"classifier_eval", "cluster_profile", "lda_topics", "topic_sweep", "cluster_map"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - FITTED))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_flagship_plan_shape(spark):
    df = E.queries()["label_keywords"](spark, SF_SMALL)
    df.collect()   # final adaptive plan
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # column pruning and pushdown reach the scan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text
    assert "IsNotNull(lang)" in text
    # the top-100 per label is limited before its shuffle
    assert "WindowGroupLimit" in text and "Partial" in text
    # the label x term grid is one aggregate shuffle on the term, no join
    assert "SortMergeJoin" not in text


def test_scalar_model_inputs_are_not_joined(spark):
    # nearest-centre assignment inlines the centres: no join in the plan
    plan = _plan(E.queries()["assign_clusters"](spark, SF_SMALL))
    assert "Join" not in plan
