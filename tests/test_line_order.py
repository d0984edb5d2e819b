"""Line items stand for events in the order of order, line number, part and price."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobscope.operators.attempts import logical_tasks
from jobscope.ordering import seq_bucket
from jobscope.sources import tables as tb
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
ORDERED = ("over (order by l_orderkey, l_linenumber, l_partkey, cast(round(l_extendedprice * 100) as bigint)) as rn "
           "from lineitem")
NAMES = ("stage_execution_asof sql_metric_values hotspot_inputs successful_logical_tasks stage_duration_stats "
         "stage_shuffle_stats stage_spill_stats exact_median nearest_rank_percentile sorted_samples executor_summary "
         "host_summary stage_first_seen").split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_lines_of_one_order_and_number_go_by_part_before_price(spark, con, name):
    sql, found = re.subn(r"over \(order by l_orderkey.*? as rn from lineitem", ORDERED, entry.oracle_sql()[name])
    assert found == 1
    assert compare(spark, con, entry.queries()[name], sql, SF) == ""
    assert sql == entry.oracle_sql()[name]


def test_line_key(spark):
    lines = [(o, n, p, c / 100) for o in (0, 1, (1 << 34) - 1) for n in (1, 7) for p in (0, 5, (1 << 33) - 1)
             for c in (1, 104_999_91, (1 << 27) - 1)]
    df = spark.createDataFrame(lines[::-1], "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double")
    keyed = tb.line_base(df.withColumns({"l_quantity": F.lit(1.0), "l_suppkey": F.lit(1)})).select(
        *df.columns, *[tb._line_seq(slot).alias(f"s{slot}") for slot in range(4)])
    rows = keyed.withColumn("bucket", seq_bucket(F.col("s0"), keyed)).orderBy("s0").collect()
    assert [tuple(r[:4]) for r in rows] == lines
    seqs = [s for r in rows for s in r[4:8]]
    assert seqs == sorted(set(seqs))
    assert [r["bucket"] for r in rows] == [r["l_orderkey"] * 8 + r["l_linenumber"] for r in rows]


def test_first_success_by_a_wide_key_is_folded_without_sorting(spark):
    plan = logical_tasks(tb.attempts(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan and plan.count("HashAggregate") >= 2
