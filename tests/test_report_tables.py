"""What the report's query reads more than once is made once, and gives the same rows."""

import pytest
from pyspark.sql import functions as F

from jobscope import queries
from jobscope.operators import attempts as at
from jobscope.operators import order_stats
from jobscope.operators.stages import stages
from jobscope.sources import tables as tb


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(3000).select(
        F.expr("id div 7").alias("l_orderkey"), F.expr("id % 37").alias("l_partkey"), F.expr("id % 30").alias("l_suppkey"),
        F.expr("cast(id % 7 + 1 as int)").alias("l_linenumber"), F.expr("cast(id % 50 as double)").alias("l_quantity"),
        F.expr("id % 1000 / 4").alias("l_extendedprice"), F.expr("array('A', 'N', 'R')[id % 3]").alias("l_returnflag"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(430).select(
        F.col("id").alias("o_orderkey"), F.expr("id % 9").alias("o_custkey"),
        F.expr("array('F', 'O', 'P')[id % 3]").alias("o_orderstatus"), F.expr("id / 4").alias("o_totalprice"),
        F.expr("timestamp_seconds(id * 1000)").alias("o_orderdate"),
        F.expr("array('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW')[id % 4]").alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_report_makes_shared_tables_once(spark, folder, monkeypatch):
    made, store = [], queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, label: made.append(label) or store(df, label))
    counted, count = [], order_stats.value_counts
    monkeypatch.setattr(order_stats, "value_counts", lambda *a: counted.append(a) or count(*a))
    rows = queries.QUERIES["report_rows"](spark, folder)
    assert len(made) == len(set(made)) and {"values", "totals", "executions", "workers", "samples"} <= set(made)
    assert len(counted) == 1 and not any("/tasks-" in f for f in rows.inputFiles())
    # each value of a stage's highest attempt, in order
    tasks = at.logical_tasks(tb.attempts(spark, folder))
    latest = at.latest_stage_attempt(at.seen_attempts(tb.stage_events(spark, folder), tb.attempts(spark, folder)))
    want = (order_stats.sorted_samples(count(tasks)).join(latest, list(at.ATTEMPT), "left_semi")
            .where("metric = 'duration_ms'").selectExpr("log_id", "stage_id", "concat_ws('|', stage_id, value, first_rank, n) v"))
    got = rows.where("section = 'taskDurationMillis'").select("log_id", F.col("position").alias("stage_id"), F.col("value").alias("v"))
    assert got.count() > 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stages_with_given_tables(spark, folder):
    attempts, events = tb.attempts(spark, folder), tb.stage_events(spark, folder)
    tasks = at.logical_tasks(attempts)
    totals = queries.workers.worker_totals(tasks, at.worker_names(attempts))
    given = stages(attempts, events, tasks=tasks, counts=order_stats.value_counts(tasks), totals=totals)
    assert sorted(map(str, given.collect())) == sorted(map(str, stages(attempts, events).collect()))
