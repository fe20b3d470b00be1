"""Plan shape checks: the plans we want at scale, not only the rows."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_pair_join(spark):
    df = E.queries()["match_join_best"](spark, SF_SMALL)
    df.collect()
    p = _plan(df)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_scans_read_only_needed_columns(spark):
    df = E.queries()["classify_owner"](spark, SF_SMALL)
    p = _plan(df)
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in p
    df = E.queries()["match_scores_1to1"](spark, SF_SMALL)
    p = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    assert "lang" not in p and "n_chars" not in p


def test_stats_are_one_aggregation(spark):
    df = E.queries()["lookup_stats"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double" in p
    assert p.count("Exchange") <= 1


def test_tier_joins_have_no_pair_join(spark):
    df = E.queries()["match_join_tiers"](spark, SF_SMALL)
    df.collect()
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_label_rows_are_read_once(spark):
    """Before: each pattern group as often as its limits name it, and all of them again in a filter."""
    from nomen.plans import queries as Q
    plan = Q.q_label_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4


def test_records_are_not_sorted_for_orders_and_owners(spark):
    """Orders and owners are the hashed sides: before, both joins sorted all the records."""
    from nomen.plans import queries as Q
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q._owner_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 2, plan
