"""A log that Spark itself writes, rolling and compressed, analysed to its report."""

import json
import subprocess
import sys

from jobscope.analysis import analyze
from jobscope.sources.eventlog import scan_event_lines

APPLICATION = """
import sys
from pyspark.sql import SparkSession, functions as F
s = (SparkSession.builder.master("local[2]").appName("real").config("spark.ui.enabled", "false")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + sys.argv[1])
     .config("spark.eventLog.rolling.enabled", "true").config("spark.eventLog.rolling.maxFileSize", "10m")
     .config("spark.eventLog.compress", "true").config("spark.eventLog.compression.codec", "zstd")
     .config("spark.sql.shuffle.partitions", "3").getOrCreate())
a = s.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("v"))
b = s.range(0, 500, 1, 2).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("w"))
a.join(b.hint("merge"), "k").collect()
try:
    s.range(4).select(F.raise_error(F.lit("on purpose"))).collect()
except Exception:
    pass
s.stop()
"""


def test_own_log_end_to_end(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    subprocess.run([sys.executable, "-c", APPLICATION, str(tmp_path / "logs")], check=True, timeout=240, capture_output=True)
    tables = analyze(scan_event_lines(spark, str(tmp_path / "logs")))
    assert [r["status"] for r in tables["log_validation"].collect()] == ["ok"]
    assert tables["applications"].first()["app_name"] == "real"
    summary = tables["summary"].first()
    assert summary["jobs_failed"] == 1 and summary["jobs_completed"] >= 1 and summary["stages_failed"] == 1 and summary["tasks"] >= 6
    executions = tables["sql_executions"].orderBy("execution_id").collect()
    assert len(executions) == 2 and executions[0]["error_message"] in (None, "") and "on purpose" in executions[1]["error_message"]
    values = {r["accumulator_id"]: r["value"] for r in tables["sql_metric_values"].where("execution_id = 0").collect()}
    assert values and all(v.lstrip("-").isdigit() for v in values.values())
    labels = [x for r in tables["plan_graph_nodes"].where("execution_id = 0").collect() for x in r["labels"]]
    assert any(x.startswith("number of output rows: ") for x in labels)
    rows = tables["report"].collect()
    sections = {r["section"] for r in rows}
    assert {"header", "application", "summary", "stages", "sqlExecutions", "failedJobs", "failedStages", "bottlenecks",
            "recommendations", "executorSummaries", "taskDurationMillis"} <= sections
    failed = [json.loads(r["json"]) for r in rows if r["section"] == "failedStages"]
    assert len(failed) == 1 and "on purpose" in failed[0]["failureReason"]
    report = {(r["section"], r["entry"]): r["value"] for r in tables["recommendation_report"].collect()}
    assert report[("application", "name")] == "real" and report[("summary", "severities")].startswith("high=")
