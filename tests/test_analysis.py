"""A small fleet of hand-written logs, analysed in one run; each test looks at its own log."""

import json

import pytest
from pyspark.sql import functions as F

from jobscope.analysis import InvalidLog, analyze
from jobscope.sources.eventlog import scan_event_lines
from tests.lines import (MIB, app_end, app_start, completed, driver_updates, job_end, job_start, node, sql_end, sql_start,
                         sql_update, submitted, task, write_log)


def exchange_branch(i, filters="IsNotNull(a), EqualTo(a,1)"):
    return node("Exchange", node("HashAggregate", node(
        "Range", text=f"Range (0, 10) [id#{i}L] PushedFilters: [{filters}]"),
        text=f"HashAggregate(keys=[id#{i}L]) [codegen id : {i}]"),
        text=f"Exchange hashpartitioning(id#{i}L, 4), [plan_id={i}]")


METRIC = [{"name": "data size", "accumulatorId": 7, "metricType": "size"}]


def fleet():
    plan4 = node("AdaptiveSparkPlan", *[node("Exchange", node("Scan parquet", text=f"s{i}"), text=f"e{i}") for i in range(4)])
    logs = {
        "minimal": [job_start(0, [0, 1]), submitted(0, name="scan", tasks=2), submitted(1, name="aggregate"),
                    task(0, 0), task(0, 1), task(1, 2)],
        "skewed": [submitted(4, tasks=10), *[task(4, i, 1000, shuffle=1000) for i in range(9)],
                   task(4, 9, 9000, shuffle=10000)],
        "shuffle_skewed": [submitted(8, tasks=10), *[task(8, i, shuffle=10 * MIB) for i in range(9)],
                           task(8, 9, shuffle=300 * MIB)],
        "nine_readers": [submitted(8, tasks=9), *[task(8, i, shuffle=10 * MIB) for i in range(8)],
                         task(8, 8, shuffle=300 * MIB)],
        "oversized": [submitted(10, tasks=4), *[task(10, i, shuffle=300 * MIB) for i in range(4)]],
        "low_parallelism": [submitted(11, tasks=6), *[task(11, i, shuffle=200 * MIB) for i in range(6)]],
        "spill": [submitted(9, tasks=2), task(9, 0, memory=64 * MIB, disk=100 * MIB), task(9, 1, memory=64 * MIB, disk=200 * MIB)],
        "spill_skew": [submitted(14, tasks=10), *[task(14, i, memory=10 * MIB) for i in range(9)], task(14, 9, memory=300 * MIB)],
        "tiny": [submitted(15, tasks=100), *[task(15, i, 200) for i in range(100)]],
        "retry": [submitted(16, tasks=3), task(16, 0, 10000, reason="ExceptionFailure", attempt=0),
                  task(16, 1, 10000, reason="ExecutorLostFailure"), task(16, 2, 10000, reason="ExceptionFailure"),
                  *[task(16, i) for i in range(3)]],
        "workers": [submitted(17, tasks=10), *[task(17, i, executor="executor-1", host="host-a") for i in range(8)],
                    *[task(17, i, executor="executor-2", host="host-b") for i in (8, 9)]],
        "failed": [job_start(12, [13]), submitted(13, tasks=2), task(13, 0, 2000, reason="ExceptionFailure"),
                   task(13, 1, 2500, reason="FetchFailed"), completed(13, tasks=2, reason="boom"), job_end(12, "JobFailed")],
        "speculation": [submitted(18, tasks=10), *[task(18, i, executor=str(i % 3), host=str(i % 3)) for i in range(10)],
                        *[task(18, i, 700, speculative=True, task_id=100 + i) for i in range(3)]],
        "many_exchanges": [sql_start(9, plan4), sql_end(9)],
        "missed_reuse": [sql_start(21, node("Union", exchange_branch(1), exchange_branch(2, "EqualTo(a,1), IsNotNull(a)"))),
                         sql_end(21)],
        "repeated": [sql_start(3, node("Union", *[node("HashAggregate", node("Project", node("Range"))) for _ in range(2)]))],
        "reused": [sql_start(4, node("Union", *[node("ReusedExchange", node("Project", node("Range"))) for _ in range(2)]))],
        # a late completion of an older attempt, remapped to another execution, changes nothing
        "late_completion": [
            sql_start(3, node("Scan parquet", metrics=METRIC)), job_start(0, [5], execution=3),
            completed(5, attempt=1, accumulables=[{"ID": 7, "Value": "10", "Metadata": "sql"}]),
            driver_updates(3, [7, 42], [8]), job_start(1, [5], execution=99),
            completed(5, attempt=0, accumulables=[{"ID": 7, "Value": "11", "Metadata": "sql"}])],
        "replayed_only": [job_start(0, [], execution=44, infos=[2]), completed(2)],
        "second_success": [submitted(1), task(1, 0, 1000, shuffle=0), task(1, 0, 2000, speculative=True, task_id=7)],
        "retried": [submitted(1), task(1, 0, 5000), completed(1, reason="lost"), submitted(1, attempt=1),
                    task(1, 0, 1000, attempt=1), completed(1, attempt=1)],
        "failures_in_both": [submitted(1), *[task(1, i, 10000, reason=r) for i, r in enumerate(["B", "A"])],
                             submitted(1, attempt=1), task(1, 0, 10000, attempt=1, reason="C"), task(1, 0, attempt=1)],
        "late_events": [submitted(1, attempt=1), task(1, 0, 1000, attempt=1), task(1, 0, 9000, attempt=0), submitted(1)],
        "no_times": [submitted(1), *[task(1, i, None) for i in range(10)], task(1, 10, 50)],
        "task_only": [task(6, 0)],
        "coercion": [{"Event": "SparkListenerTaskEnd", "Stage ID": "7", "Task Info": {"Index": 1.9, "Task ID": "x",
                      "Launch Time": "10", "Finish Time": 30.7}}],
        "explicit_flag": [submitted(1), task(1, 0, Successful=True), task(1, 1, Successful=False), task(1, 2, Successful=None),
                          task(1, 3, reason="TaskKilled")],
        "empty_reason": [completed(2, reason="")],
        "nulls_overwrite": [submitted(2, name="first", tasks=3), completed(2, name=None, tasks=None)],
        "loose": [task(None, 0, task_id=5), task(None, 1, task_id=5), task(None, 2, task_id=6)],
        "jobs": [job_start(0), job_end(0, "JobFailed"), job_end(1, "JobFailed"), job_end(0), job_end(0, None)],
        "restarted_sql": [sql_update(1, node("Sort"), "u0"), sql_start(1, node("Scan a"), text="s1"),
                          sql_update(1, None, None), sql_update(1, node("Join b"), "u1"), sql_start(1, node("Scan c"), text=None),
                          sql_end(1, 1060, "")],
    }
    return {k: [app_start(k), *v, app_end()] for k, v in logs.items()} | {
        "two_starts": [app_start(), app_start()], "nothing": [{"Event": "Other"}], "broken": [app_start(), "{oops"]}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    for name, lines in fleet().items():
        write_log(root / f"{name}.json", lines)
    out = {}
    tables = analyze(scan_event_lines(spark, str(root)))
    for key in ("log_validation", "applications", "summary", "jobs", "stages", "workers", "samples", "sql_executions",
                "sql_metric_values", "duplicate_subtrees", "plan_graph_nodes", "plan_graph_edges", "findings",
                "recommendations", "report", "hotspots", "sql_report"):
        table = tables[key].withColumn("log", F.regexp_extract("log_id", r"([^/]*)\.json$", 1))
        if key == "report":
            table = table.withColumn("json", F.col("json").cast("string"))
        out[key] = [r.asDict(recursive=True) for r in table.collect()]
    return out


@pytest.fixture
def rows(results):
    def pick(table, log):
        return [r for r in results[table] if r["log"] == log]

    return pick


def one(found):
    assert len(found) == 1, found
    return found[0]


def test_validation(results):
    status = {r["log"]: r["status"] for r in results["log_validation"]}
    assert {k: v for k, v in status.items() if v != "ok"} == {
        "two_starts": "several_applications", "nothing": "no_events", "broken": "corrupt"}
    assert not {r["log"] for r in results["summary"]} & {"two_starts", "nothing", "broken"}


def test_minimal(rows):
    s = one(rows("summary", "minimal"))
    assert (s["jobs"], s["stages"], s["tasks"], s["issues"]) == (1, 2, 3, 0)
    assert s["jobs_completed"] == s["stages_completed"] == s["stages_failed"] == 0
    app = one(rows("applications", "minimal"))
    assert (app["app_id"], app["duration_ms"]) == ("minimal", 8000)


@pytest.mark.parametrize("log, expected", [
    ("skewed", [("task_duration_skew", "medium")]),
    ("shuffle_skewed", [("shuffle_partition_skew", "high")]),
    ("nine_readers", [("oversized_shuffle_partitions", "medium")]),
    ("oversized", [("oversized_shuffle_partitions", "medium")]),
    ("low_parallelism", [("low_shuffle_parallelism", "medium")]),
    ("spill", [("spill_pressure", "medium")]),
    ("spill_skew", [("memory_spill_skew", "medium")]),
    ("tiny", [("too_many_tiny_tasks", "medium")]),
    ("retry", [("retry_waste", "medium")]),
    ("workers", [("executor_imbalance", "medium"), ("host_imbalance", "medium")]),
    ("failed", [("failed_job", "high"), ("failed_stage", "high")]),
    ("speculation", [("speculation_heavy", "medium")]),
    ("many_exchanges", [("sql_many_exchanges", "medium")]),
    ("missed_reuse", [("possible_missed_exchange_reuse", "medium")]),
    ("repeated", [("duplicate_sql_subtree", "medium")]),
    ("reused", [("duplicate_sql_subtree", "medium")]),
    ("minimal", []), ("no_times", []), ("retried", []),
])
def test_findings(rows, log, expected):
    found = sorted(rows("findings", log), key=lambda r: r["position"])
    assert [(r["type"], r["severity"]) for r in found] == expected
    assert [r["instance_id"] for r in found] == [f"bottleneck-{i + 1}" for i in range(len(expected))]
    assert sorted(r["related_id"] for r in rows("recommendations", log)) == [r["instance_id"] for r in found]


def test_evidence(rows):
    ev = {log: json.loads(one(rows("findings", log))["evidence"]) for log in
          ("skewed", "shuffle_skewed", "spill", "spill_skew", "tiny", "retry", "speculation", "missed_reuse", "repeated")}
    assert ev["skewed"] == {"completedTasks": 10, "avgTaskDurationMillis": 1800, "maxTaskDurationMillis": 9000, "skewRatio": 5.0}
    assert ev["shuffle_skewed"]["skewRatio"] == 30.0
    assert (ev["spill"]["diskBytesSpilled"], ev["spill"]["memoryBytesSpilled"]) == (314572800, 134217728)
    assert ev["spill_skew"]["skewRatio"] == 30.0
    assert (ev["tiny"]["avgTaskDurationMillis"], ev["tiny"]["p95TaskDurationMillis"], ev["tiny"]["avgTaskShuffleReadBytes"]) == (200, 200, 0)
    assert ev["retry"]["failedTaskAttemptReasons"] == ["ExceptionFailure", "ExecutorLostFailure"]
    assert ev["retry"]["failedTaskAttemptDurationMillis"] == 30000
    assert (ev["speculation"]["speculativeAttemptShare"], ev["speculation"]["duplicateSuccessfulTaskAttempts"]) == (0.3, 3)
    assert ev["missed_reuse"]["topDuplicateRoot"] == "Exchange" and ev["missed_reuse"]["topDuplicateSubtreeSize"] == 3
    assert ev["repeated"]["topDuplicateRoot"] == "HashAggregate" and ev["repeated"]["duplicateGroups"] == 1


def test_statistics(rows):
    s = one(rows("stages", "skewed"))
    assert (s["median_shuffle_read_bytes"], s["p95_shuffle_read_bytes"], s["p99_shuffle_read_bytes"]) == (1000, 10000, 10000)
    samples = sorted((r["value"], r["first_rank"], r["n"]) for r in rows("samples", "skewed") if r["metric"] == "duration_ms")
    assert samples == [(1000, 1, 9), (9000, 10, 1)]
    shares = {(r["kind"], r["worker_id"]): r["task_share"] for r in rows("workers", "workers")}
    assert shares[("executor", "executor-1")] == shares[("host", "host-a")] == 0.8


def test_failed(rows):
    s = one(rows("summary", "failed"))
    assert (s["tasks"], s["jobs_failed"], s["stages_failed"], s["issues"]) == (0, 1, 1, 2)
    stage_ = one(rows("stages", "failed"))
    assert (stage_["failed_attempts"], stage_["failed_ms"], stage_["outcome"]) == (2, 4500, "failed")
    text = next(r["description"] for r in rows("recommendations", "failed") if r["type"] == "failed_stage")
    assert "boom" in text and "2 failed task attempts taking 4.5 s" in text and "ExceptionFailure, FetchFailed" in text


def test_attempts(rows):
    second = one(rows("stages", "second_success"))
    assert (second["duration_max_ms"], second["duplicate_successes"], second["speculative_ms"]) == (1000, 1, 2000)
    assert second["shuffle_samples"] == 1 and second["shuffle_max_bytes"] == 0
    retried = one(rows("stages", "retried"))
    assert (retried["stage_attempt_id"], retried["duration_max_ms"], retried["outcome"]) == (1, 1000, "completed")
    both = one(rows("stages", "failures_in_both"))
    assert (both["all_failed_attempts"], both["all_failed_ms"], both["all_reasons"]) == (3, 30000, ["B", "A", "C"])
    assert (both["failed_attempts"], both["attempt_reasons"]) == (1, ["C"])
    late = one(rows("stages", "late_events"))
    assert (late["stage_attempt_id"], late["duration_max_ms"]) == (1, 1000)
    assert one(rows("summary", "late_events"))["tasks"] == 1


def test_partial_logs(rows):
    bare = one(rows("stages", "no_times"))
    assert (bare["completed_tasks"], bare["duration_samples"]) == (11, 1)
    only = one(rows("stages", "task_only"))
    assert (only["stage_id"], only["stage_name"], only["num_tasks"], only["outcome"]) == (6, None, None, "unknown")
    loose = one(rows("stages", "coercion"))
    assert (loose["stage_id"], loose["duration_max_ms"], loose["completed_tasks"]) == (7, 20, 1)
    assert one(rows("summary", "loose"))["tasks"] == 2
    flags = one(rows("stages", "explicit_flag"))
    assert (flags["completed_tasks"], flags["failed_attempts"]) == (1, 3)
    assert one(rows("stages", "empty_reason"))["outcome"] == "failed"
    blank = one(rows("stages", "nulls_overwrite"))
    assert (blank["stage_name"], blank["num_tasks"]) == (None, None)


def test_jobs(rows):
    state = {r["job_id"]: r for r in rows("jobs", "jobs")}
    assert (state[0]["state"], state[0]["result"], state[1]["state"]) == ("failed", None, "failed")
    # job 0 succeeded in between, so its failure now counts as later than that of job 1
    assert state[1]["failed_seq"] < state[0]["failed_seq"]


def test_sql(rows):
    assert [r["execution_id"] for r in rows("sql_executions", "late_completion")] == [3]
    assert [(r["accumulator_id"], r["value"]) for r in rows("sql_metric_values", "late_completion")] == [(7, "42")]
    assert one(rows("plan_graph_nodes", "late_completion"))["labels"] == ["data size: 42 B"]
    assert [r["execution_id"] for r in rows("sql_executions", "replayed_only")] == [44]
    again = one(rows("sql_executions", "restarted_sql"))
    assert again["latest_plan_description"] is None and json.loads(again["latest_plan_json"])["nodeName"] == "Scan c"
    report = one(rows("sql_report", "restarted_sql"))
    assert (report["status"], report["duration_ms"], report["scans"]) == ("success", 960, 1)
    edges = {(r["parent"], r["child"]) for r in rows("plan_graph_edges", "missed_reuse")}
    assert edges == {("n0", "n1"), ("n1", "n2"), ("n2", "n3"), ("n0", "n4"), ("n4", "n5"), ("n5", "n6")}
    first = one([r for r in rows("duplicate_subtrees", "missed_reuse") if r["root"] == "Exchange"])
    assert (first["count"], first["subtree_depth"], first["operators"]) == (2, 3, ["Exchange", "HashAggregate", "Range"])


def test_report(rows):
    found = {}
    for r in rows("report", "failed"):
        found.setdefault(r["section"], []).append(json.loads(r["json"]))
    assert {k: len(v) for k, v in found.items()} == {
        "header": 1, "application": 1, "summary": 1, "stages": 1, "failedJobs": 1, "failedStages": 1, "bottlenecks": 2,
        "recommendations": 2}
    assert found["header"][0]["schemaVersion"] == "1"
    assert found["summary"][0]["issuesDetected"] == 2
    assert found["bottlenecks"][0]["evidence"]["result"] == "JobFailed"
    assert found["failedStages"][0]["failureReason"] == "boom"
    assert "sparkPlanInfo" not in json.dumps(found)
    assert one(rows("hotspots", "failed"))["failed"] is True


def test_strict_mode(spark, tmp_path):
    write_log(tmp_path / "bad.json", [app_start(), app_start()])
    with pytest.raises(InvalidLog):
        analyze(scan_event_lines(spark, str(tmp_path)), strict=True)
