"""Reports as tables, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope import __version__
from jobscope.functions.display import scope_text, sql_status, text_or_unknown
from jobscope.operators.findings import evidence_rows
from jobscope.operators.sqlexec import CATEGORIES, EXECUTION
from jobscope.plans.subtrees import duplicate_rank

SCHEMA_VERSION = "1"
PRODUCER = "jobscope"
SAMPLE_SECTIONS = {
    "duration_ms": "taskDurationMillis", "shuffle_read_bytes": "taskShuffleReadBytes",
    "memory_bytes_spilled": "taskMemoryBytesSpilled", "disk_bytes_spilled": "taskDiskBytesSpilled"}


def stage_document(stages: DataFrame) -> DataFrame:
    """Stages with the field names of the report.  Sample arrays are a table of their own (run-length encoded)."""
    def stats(sample: str, label: str) -> list[Column]:
        return [F.col(f"{s}_{sample}").alias(f"{s}Task{label}") for s in ("median", "p95", "p99")]

    return stages.select(
        "log_id", F.col("stage_id").alias("id"), F.col("stage_name").alias("name"), F.col("num_tasks").alias("taskCount"),
        F.col("completed_tasks").alias("completedTasks"), F.col("duration_min_ms").alias("minTaskDurationMillis"),
        F.col("duration_max_ms").alias("maxTaskDurationMillis"), F.col("duration_avg_ms").alias("avgTaskDurationMillis"),
        *stats("duration_ms", "DurationMillis"),
        F.col("all_failed_attempts").alias("failedTaskAttempts"),
        F.col("all_failed_ms").alias("failedTaskAttemptDurationMillis"),
        F.col("all_reasons").alias("failedTaskAttemptReasons"),
        F.col("speculative_attempts").alias("speculativeTaskAttempts"),
        F.col("speculative_ms").alias("speculativeTaskAttemptDurationMillis"),
        F.col("duplicate_successes").alias("duplicateSuccessfulTaskAttempts"),
        F.col("shuffle_total_bytes").alias("shuffleReadBytes"), F.col("shuffle_max_bytes").alias("maxTaskShuffleReadBytes"),
        *stats("shuffle_read_bytes", "ShuffleReadBytes"),
        F.col("memory_total_bytes").alias("memoryBytesSpilled"), F.col("disk_total_bytes").alias("diskBytesSpilled"),
        F.col("memory_max_bytes").alias("maxTaskMemoryBytesSpilled"),
        F.col("disk_max_bytes").alias("maxTaskDiskBytesSpilled"),
        *stats("memory_bytes_spilled", "MemoryBytesSpilled"), *stats("disk_bytes_spilled", "DiskBytesSpilled"))


def _section(df: DataFrame, name: str, position: Column, *fields: Column | str) -> DataFrame:
    return df.select(
        "log_id", F.lit(name).alias("section"), position.cast("bigint").alias("position"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def report_rows(applications: DataFrame, summary: DataFrame, stages: DataFrame, executions: DataFrame,
                operator_counts: DataFrame, failed_jobs: DataFrame, findings: DataFrame,
                recommendations: DataFrame, workers: DataFrame | None = None,
                samples: DataFrame | None = None) -> DataFrame:
    """The whole report, one row per object.

    The executors, hosts and samples of a stage are rows of their own too, positioned by the stage.

    A log's report can hold any number of stages and findings, so it is kept as
    rows with their section and never gathered into one value.
    """
    c = F.col
    operators = operator_counts.groupBy(*EXECUTION).agg(
        F.array_sort(F.collect_list(F.struct((-c("count")).alias("_o"), c("node_name").alias("name"), "count")))
        .alias("_ops"))
    operators = operators.select(*EXECUTION, F.transform(
        "_ops", lambda o: F.struct(o["name"].alias("name"), o["count"].alias("count"))).alias("operatorSummaries"))
    executions = executions.join(operators, [*EXECUTION], "left").withColumn(
        "operatorSummaries", F.coalesce("operatorSummaries", F.array().cast("array<struct<name:string,count:bigint>>")))
    zero = F.lit(0)
    broken = stages.where(c("outcome") == "failed")
    documents = stage_document(stages)
    parts = [
        _section(summary, "header", zero, F.lit(SCHEMA_VERSION).alias("schemaVersion"),
                 F.struct(F.lit(PRODUCER).alias("name"), F.lit(__version__).alias("version")).alias("producer")),
        _section(applications, "application", zero, c("app_id").alias("id"), c("app_name").alias("name"),
                 c("start_ms").alias("startTimeMillis"), c("end_ms").alias("endTimeMillis"),
                 c("duration_ms").alias("durationMillis")),
        _section(summary, "summary", zero, "jobs", c("jobs_completed").alias("jobsCompleted"),
                 c("jobs_failed").alias("jobsFailed"), "stages", c("stages_completed").alias("stagesCompleted"),
                 c("stages_failed").alias("stagesFailed"), "tasks", c("issues").alias("issuesDetected")),
        _section(documents, "stages", c("id"), *[x for x in documents.columns if x != "log_id"]),
        _section(executions, "sqlExecutions", c("execution_id"), c("execution_id").alias("id"),
                 c("root_execution_id").alias("rootExecutionId"), "description", "details",
                 c("start_ms").alias("startTimeMillis"), c("end_ms").alias("endTimeMillis"),
                 c("duration_ms").alias("durationMillis"), c("plan_description").alias("physicalPlanDescription"),
                 c("latest_plan_description").alias("latestPhysicalPlanDescription"),
                 c("error_message").alias("errorMessage"), "operatorSummaries"),
        _section(failed_jobs, "failedJobs", c("job_id"), c("job_id").alias("id"), "result"),
        _section(broken, "failedStages", c("stage_id"), c("stage_id").alias("id"), c("completion.stage_name").alias("name"),
                 c("completion.failure_reason").alias("failureReason"), c("failed_attempts").alias("failedTaskAttempts"),
                 c("failed_ms").alias("failedTaskAttemptDurationMillis"),
                 c("attempt_reasons").alias("failedTaskAttemptReasons")),
        _section(findings, "bottlenecks", c("position"), c("instance_id").alias("instanceId"), "type", "severity",
                 "message", c("stage_id").alias("stageId"), F.parse_json("evidence").alias("evidence")),
        _section(recommendations, "recommendations", c("position"), c("recommendation_id").alias("id"), "severity",
                 "title", "description", c("type").alias("relatedBottleneckType"), c("stage_id").alias("stageId"),
                 c("related_id").alias("relatedBottleneckId")),
    ]
    if workers is not None:
        parts += [_section(workers.where(c("kind") == kind), section, c("stage_id"), c("stage_id").alias("stageId"),
                           c("worker_id").alias(label), c("task_count").alias("taskCount"),
                           c("duration_ms").alias("durationMillis"), c("task_share").alias("taskShare"),
                           c("duration_share").alias("durationShare"))
                  for kind, section, label in (("executor", "executorSummaries", "executorId"), ("host", "hostSummaries", "host"))]
    if samples is not None:
        parts += [_section(samples.where(c("metric") == metric), section, c("stage_id"), c("stage_id").alias("stageId"),
                           c("value"), c("first_rank").alias("firstRank"), c("n").alias("count"))
                  for metric, section in SAMPLE_SECTIONS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _entries(df: DataFrame, section: str, position: Column, entries: dict[str, Column]) -> DataFrame:
    """One row per entry that has a value."""
    listed = F.array(*[F.struct(F.lit(k).alias("entry"), v.cast("string").alias("value")) for k, v in entries.items()])
    return df.select("log_id", F.lit(section).alias("section"), position.cast("bigint").alias("position"), F.inline(listed)).where(
        F.col("value").isNotNull())


def recommendation_report(applications: DataFrame, summary: DataFrame, severities: DataFrame, hotspots: DataFrame,
                          recommendations: DataFrame, findings: DataFrame) -> DataFrame:
    """The recommendation report, ``log_id, section, position, entry, value``: the application, the counts with the
    severities, the stages that stand out by rank, and the recommendations by position with the evidence of their findings.
    """
    c = F.col
    unknown = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    zero = F.lit(0)
    known = summary.join(applications, "log_id", "left").join(
        severities.select("log_id", c("summary").alias("severities")), "log_id", "left")
    named = findings.withColumnRenamed("instance_id", "related_id")
    advice = recommendations.join(named.select("log_id", "related_id", "execution_id"), ["log_id", "related_id"])
    scope = scope_text(c("stage_id"), c("execution_id"))
    counts = ("jobs", "jobs_completed", "jobs_failed", "stages", "stages_completed", "stages_failed", "tasks", "issues")
    evidence = evidence_rows(named, "log_id", "position")
    parts = [
        _entries(known, "application", zero, {
            "name": text_or_unknown(c("app_name")), "id": text_or_unknown(c("app_id")), "durationMillis": unknown(c("duration_ms"))}),
        _entries(known, "summary", zero, {n: c(n) for n in counts} | {"severities": F.coalesce("severities", F.lit("none"))}),
        _entries(hotspots, "hotspots", c("rank"), {
            "stageId": c("stage_id"), "name": text_or_unknown(c("stage_name")), "issues": c("issues"),
            "failed": F.when(c("failed"), F.lit("true")), "completedTasks": c("completed_tasks"),
            "avgTaskDurationMillis": unknown(c("duration_avg_ms")), "maxTaskDurationMillis": unknown(c("duration_max_ms")),
            "shuffleReadBytes": c("shuffle_total_bytes"), "memoryBytesSpilled": c("memory_total_bytes"),
            "diskBytesSpilled": c("disk_total_bytes")}),
        _entries(advice, "recommendations", c("position"), {
            "title": c("title"), "severity": c("severity"), "scope": scope, "relatedBottleneck": c("type"),
            "description": c("description")}),
        # a recommendation has the position of its finding
        evidence.join(recommendations.select("log_id", "position"), ["log_id", "position"], "left_semi").select(
            "log_id", F.lit("evidence").alias("section"), "position", c("key").alias("entry"), c("display").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sql_execution_report(executions: DataFrame, operator_counts: DataFrame, categories: DataFrame,
                         duplicates: DataFrame) -> DataFrame:
    """One row per SQL execution.  Nested lists stay within one plan, which one event carried."""
    operators = operator_counts.groupBy(*EXECUTION).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("count")).alias("o"), F.col("node_name").alias("name")))).alias("_ops"))
    repeated = duplicates.groupBy(*EXECUTION).agg(F.array_sort(F.collect_list(F.struct(
        duplicate_rank().alias("o"), "root", "count", "subtree_size", "subtree_depth", "operators", "interesting")))
        .alias("_dups"))
    joined = (executions.join(categories, [*EXECUTION], "left").join(operators, [*EXECUTION], "left")
              .join(repeated, [*EXECUTION], "left"))
    return joined.select(
        *EXECUTION, text_or_unknown(F.col("description")).alias("description"), "root_execution_id",
        "start_ms", "end_ms", "duration_ms", sql_status(F.col("error_message"), F.col("end_ms")).alias("status"),
        "error_message", "details", "plan_description", "latest_plan_description",
        *[F.coalesce(c.lower().replace(" ", "_"), F.lit(0)).alias(c.lower().replace(" ", "_")) for c in CATEGORIES],
        F.transform("_ops", lambda o: F.struct(o["name"].alias("name"), (-o["o"]).alias("count"))).alias("operators"),
        F.transform("_dups", lambda d: F.struct(
            d["root"].alias("root"), d["count"].alias("count"), d["subtree_size"].alias("subtree_size"),
            d["subtree_depth"].alias("subtree_depth"), d["operators"].alias("operators"),
            d["interesting"].alias("interesting"))).alias("repeated_subtrees"))


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table as parquet under ``path``; rows of one log are spread over as many files as they need."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def write_report(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The report as JSON lines, one folder per section."""
    rows.write.mode(mode).partitionBy("section").json(path)
