"""Every operator as a query over a folder of stored tables.

Integers are widened and lists joined to text, so that results have plain,
engine-neutral columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope import report
from jobscope.functions.coerce import lenient_long
from jobscope.functions.display import human_bytes, human_millis, sql_status
from jobscope.functions.plan_text import normalize_plan_text
from jobscope.operators import advise, attempts as at
from jobscope.operators import findings as fd
from jobscope.operators import jobs, order_stats, rules, sanitize, sqlexec, workers
from jobscope.operators.stages import stages
from jobscope.ordering import count_places, number_rows, seq_bucket
from jobscope.plans import flatten, graph, subtrees
from jobscope.session import materialize, scratch_path
from jobscope.sources import eventlog as el
from jobscope.sources import events as ev
from jobscope.sources import listener_lines as ll
from jobscope.sources import tables as tb
from jobscope.sources.codecs import decode_framed_files
from jobscope.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
ATTEMPT, STAGE, EXECUTION = at.ATTEMPT, at.STAGE, sqlexec.EXECUTION


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, lists of text as one comma-separated text."""

    def column(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return at.logical_tasks(tb.attempts(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return at.stage_attempt_metrics(_tasks(spark, d))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return at.latest_stage_attempt(at.seen_attempts(tb.stage_events(spark, d), tb.attempts(spark, d)))


def _of_latest(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    return df.join(_latest(spark, d).select(*ATTEMPT), [*ATTEMPT], "left_semi")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return order_stats.value_counts(_tasks(spark, d))


def _stages(spark: SparkSession, d: str, **parts: object) -> DataFrame:
    return stages(tb.attempts(spark, d), tb.stage_events(spark, d), **parts)


def _stored_stages(spark: SparkSession, d: str) -> DataFrame:
    """The full stage table with the logical tasks stored once for its several branches."""
    tasks = materialize(_tasks(spark, d), "tasks")
    return stages(tb.attempts(spark, d), tb.stage_events(spark, d), tasks=tasks)


def _workers(spark: SparkSession, d: str) -> DataFrame:
    tasks = _tasks(spark, d)
    names = at.worker_names(tb.attempts(spark, d))
    return workers.worker_summary(workers.worker_totals(tasks, names), at.stage_attempt_metrics(tasks))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.job_state(tb.job_events(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten.plan_nodes(tb.plans(spark, d))


def _executions(spark: SparkSession, d: str) -> DataFrame:
    return sqlexec.sql_executions(tb.sql_execution_events(spark, d))


def _signals(spark: SparkSession, d: str, executions: DataFrame | None = None) -> DataFrame:
    plans = tb.plans(spark, d)
    executions = _executions(spark, d) if executions is None else executions
    return rules.execution_signals(executions, plans, subtrees.duplicate_subtrees(plans))


def _stage_findings(stage_table: DataFrame) -> DataFrame:
    return fd.all_findings(rules.built_in_rules(), stages=stage_table)


def _findings(spark: SparkSession, d: str, stage_table: DataFrame | None = None,
              executions: DataFrame | None = None) -> DataFrame:
    stage_table = _stored_stages(spark, d) if stage_table is None else stage_table
    return fd.all_findings(
        rules.built_in_rules(), stages=stage_table, executions=_signals(spark, d, executions),
        failed_jobs=jobs.failed_jobs(_jobs(spark, d)))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return fd.number_findings(materialize(_findings(spark, d), "findings"))


def _asof(spark: SparkSession, d: str) -> DataFrame:
    return sqlexec.stage_execution_asof(tb.job_stage_map(spark, d), tb.stage_events(spark, d))


def _replay(spark: SparkSession, d: str) -> DataFrame:
    replayed = sqlexec.replayed_completions(tb.job_stage_map(spark, d), tb.stage_events(spark, d), tb.attempts(spark, d))
    return sqlexec.accumulator_replay(tb.driver_accum_updates(spark, d), tb.stage_accumulables(spark, d), replayed)


def _rule(name: str) -> Query:
    ranked = {"shuffle_partition_skew": "shuffle_read_bytes", "oversized_shuffle_partitions": "shuffle_read_bytes",
              "memory_spill_skew": "memory_bytes_spilled", "disk_spill_skew": "disk_bytes_spilled",
              "too_many_tiny_tasks": "duration_ms"}.get(name)
    spread = name in {"executor_imbalance", "host_imbalance"}
    why = name in {"retry_waste", "failed_stage"}

    def run(spark: SparkSession, d: str) -> DataFrame:
        rule = next(r for r in rules.built_in_rules() if r.name == name)
        if rule.source == "executions":
            return rules.apply_rule(rule, _signals(spark, d))
        if rule.source == "failed_jobs":
            return rules.apply_rule(rule, jobs.failed_jobs(_jobs(spark, d)))
        return rules.apply_rule(rule, _stages(spark, d, statistics=(ranked,) if ranked else (), spread=spread, reasons=why))

    return run


def _recognise(spark: SparkSession, d: str) -> DataFrame:
    return ev.recognise_events(tb.mixed_lines(spark, d)).drop("seq")


def _parsed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts written as listener lines, stored, and parsed back."""
    lines = materialize(tb.task_lines(tb.attempts(spark, d)), "lines")
    return ev.task_attempts(ev.recognise_events(lines)).drop("seq")


def _extract(spark: SparkSession, d: str) -> DataFrame:
    return tb.loose_values(spark, d).select(
        "l_orderkey", "l_linenumber", lenient_long(F.from_json("value", "v string")["v"]).alias("number"))


def _task_success(spark: SparkSession, d: str) -> DataFrame:
    return _parsed_attempts(spark, d).select("log_id", "task_id", "success", "reason")


def _union(spark: SparkSession, d: str) -> DataFrame:
    return sqlexec.accumulator_union(tb.driver_accum_updates(spark, d), tb.stage_accumulables(spark, d)).drop("seq")


def _suppressed(spark: SparkSession, d: str) -> DataFrame:
    """The two overlapping plan rules evaluated without the built-in exclusion, then reduced."""
    signals = _signals(spark, d)
    listed = []
    for rule in rules.built_in_rules():
        if rule.name == "duplicate_sql_subtree":
            listed.append(rules.Rule(rule.name, rule.source, rule.order, rule.message,
                                     F.col("repeated_groups") > 0, rule.severity, rule.evidence))
        elif rule.name == "possible_missed_exchange_reuse":
            listed.append(rule)
    both = fd.all_findings(listed, executions=signals)
    return fd.suppress_duplicates(both).select("log_id", "type", "stage_id", "execution_id")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Every second recommendation forgets its finding and is linked by turn."""
    found = materialize(_numbered(spark, d).select("log_id", "position", "type", "stage_id", "instance_id"), "numbered")
    given = found.select("log_id", "position", "type", "stage_id",
                         F.when(F.col("position") % 2 == 0, F.col("instance_id")).alias("related_id"))
    return advise.link_recommendations(given, found)


def _hotspot_inputs(spark: SparkSession, d: str) -> DataFrame:
    table = materialize(_stored_stages(spark, d), "stages")
    return fd.hotspot_inputs(table, _stage_findings(table))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return subtrees.subtree_members(tb.plans(spark, d)).select(*EXECUTION, "ord", "operators")


def _shape(spark: SparkSession, d: str) -> DataFrame:
    return flatten.plan_nodes(flatten.flatten_plans(tb.plan_json(spark, d))).select(
        *EXECUTION, "ord", "subtree_size", "subtree_depth")


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select(*EXECUTION, "ord", (F.col("ord") + F.col("subtree_size")).alias("end_ord"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    attempts = tb.attempts(spark, d)
    table = materialize(_stored_stages(spark, d), "stages")
    return jobs.summary_counts(attempts, _jobs(spark, d), table, at.tasks_without_stage(attempts),
                               _findings(spark, d, table))


def _job_state(spark: SparkSession, d: str) -> DataFrame:
    state = _jobs(spark, d)
    failed = number_rows(state.where(F.col("state") == "failed"), ["log_id"], [seq_bucket(F.col("failed_seq"), state)],
                         [F.col("failed_seq")], "failed_rank")
    return state.join(failed.select("log_id", "job_id", "failed_rank"), ["log_id", "job_id"], "left").drop("failed_seq")


def _task_count(spark: SparkSession, d: str) -> DataFrame:
    attempts = tb.attempts(spark, d)
    by_log = _of_latest(spark, d, at.stage_attempt_metrics(at.logical_tasks(attempts))).groupBy("log_id").agg(
        F.sum("completed_tasks").alias("t"))
    return by_log.join(at.tasks_without_stage(attempts), "log_id", "left").select(
        "log_id", (F.col("t") + F.coalesce("loose_tasks", F.lit(0))).alias("tasks"))


def _metric_columns(*columns: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _of_latest(spark, d, _metrics(spark, d).select(*ATTEMPT, *columns))

    return run


def _worker_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        mine = _workers(spark, d).where(F.col("kind") == kind)
        return _of_latest(spark, d, mine.select(
            *ATTEMPT, "worker_id", "task_count", "duration_ms", "task_share", "duration_share"))

    return run


def _failed_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d, statistics=(), spread=False).select(
        *ATTEMPT, "failed_attempts", "failed_ms", "attempt_reasons", "all_failed_attempts", "all_failed_ms", "all_reasons")


def _operator_counts(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy(*EXECUTION).orderBy(F.desc("count"), "node_name")
    return sqlexec.operator_counts(_nodes(spark, d)).withColumn("rank", F.row_number().over(order))


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy(*EXECUTION).orderBy(subtrees.duplicate_rank())
    return subtrees.duplicate_subtrees(tb.plans(spark, d)).withColumn("rank", F.row_number().over(order)).drop(
        "fingerprint", "first_ord")


def _first_seen(spark: SparkSession, d: str) -> DataFrame:
    latest = _latest(spark, d)
    return number_rows(latest, ["log_id"], [seq_bucket(F.col("first_seq"), latest)], [F.col("first_seq")], "position").select(
        *STAGE, "position")


def _instance_ids(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("log_id", "type", "stage_id", "execution_id", "instance_id")


def _scaled_bytes(spark: SparkSession, d: str) -> DataFrame:
    x = F.expr("cast(round(l_extendedprice * 100) as bigint) * cast(power(10, l_linenumber - 2) as bigint) "
               "* (l_linenumber % 3)")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", x.alias("x"), human_bytes(x).alias("text"))


def _scaled_millis(spark: SparkSession, d: str) -> DataFrame:
    x = F.expr("cast(round(l_extendedprice) as bigint) * (l_linenumber % 5) * cast(l_quantity as bigint)")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", x.alias("x"), human_millis(x).alias("text"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return fd.evidence_rows(materialize(_findings(spark, d), "findings"), "log_id", "stage_id", "execution_id", "type")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return advise.recommend(_numbered(spark, d)).select("log_id", "position", "type", "title", "description")


def _sql_report(spark: SparkSession, d: str) -> DataFrame:
    plans = tb.plans(spark, d)
    counts = sqlexec.operator_counts(flatten.plan_nodes(plans))
    rows = report.sql_execution_report(
        _executions(spark, d), counts, sqlexec.operator_categories(counts), subtrees.duplicate_subtrees(plans))
    named = F.transform("operators", lambda o: F.concat(o["name"], F.lit("="), o["count"].cast("string")))
    repeated = F.transform("repeated_subtrees", lambda r: F.concat_ws(
        "/", r["root"], r["count"], r["subtree_size"], r["subtree_depth"], F.array_join(r["operators"], "+"),
        F.array_join(r["interesting"], "+")))
    return rows.withColumns({"operators": named, "repeated_subtrees": F.coalesce(F.array_join(repeated, ","), F.lit(""))})


def _report_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    attempts, plans = tb.attempts(spark, d), tb.plans(spark, d)
    tasks = materialize(_tasks(spark, d), "tasks")
    latest = materialize(_latest(spark, d).select(*ATTEMPT), "latest")
    totals = materialize(workers.worker_totals(tasks, at.worker_names(attempts)), "totals")
    values = materialize(order_stats.value_counts(tasks), "values")
    counts = sqlexec.operator_counts(flatten.plan_nodes(plans))
    executions = materialize(_executions(spark, d), "executions")
    table = materialize(stages(attempts, tb.stage_events(spark, d), tasks=tasks, counts=values, totals=totals), "stages")
    found = materialize(fd.number_findings(materialize(_findings(spark, d, table, executions), "findings")), "numbered")
    state = _jobs(spark, d)
    return {
        "applications": jobs.applications(tb.application_events(spark, d)),
        "summary": jobs.summary_counts(attempts, state, table, at.tasks_without_stage(attempts), found),
        "stages": table, "executions": executions, "operator_counts": counts,
        "failed_jobs": jobs.failed_jobs(state), "findings": found, "recommendations": advise.recommend(found),
        "workers": workers.worker_summary(totals, at.stage_attempt_metrics(tasks)).join(latest, [*ATTEMPT], "left_semi"),
        "samples": order_stats.sorted_samples(values).join(latest, [*ATTEMPT], "left_semi")}


def _report(spark: SparkSession, d: str) -> DataFrame:
    """The report's rows, taken apart into their entries; shares in four digits, rows of workers and samples as a whole."""
    t = _report_tables(spark, d)
    # each is read by several sections
    rows = report.report_rows(**t | {name: materialize(t[name], name) for name in ("workers", "samples")})
    listed = F.col("section").isin(*report.SAMPLE_SECTIONS.values(), "executorSummaries", "hostSummaries")
    four = lambda x: F.call_function("format_number", x.cast("double"), F.lit("0.0000"))
    fields = F.transform(F.map_entries(F.from_json("json", "map<string,string>")), lambda e: F.struct(
        e["key"].alias("entry"), F.when(e["key"].endswith("Share"), four(e["value"])).otherwise(e["value"]).alias("value")))
    one = F.array(F.struct(F.lit("row").alias("entry"), F.array_join(fields["value"], "|").alias("value")))
    return rows.select("log_id", "section", "position", F.inline(F.when(listed, one).otherwise(fields))).where("value is not null")


def _recommendation_report(spark: SparkSession, d: str) -> DataFrame:
    t = _report_tables(spark, d)
    hotspots = fd.stage_hotspots(fd.hotspot_inputs(t["stages"], t["findings"]))
    return report.recommendation_report(t["applications"], t["summary"], fd.severity_counts(t["findings"]), hotspots,
                                        t["recommendations"], t["findings"])


def _flattened(spark: SparkSession, d: str) -> DataFrame:
    return flatten.plan_nodes(flatten.flatten_plans(tb.plan_json(spark, d))).select(
        *EXECUTION, "ord", "depth", "node_name", "simple_string")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return sanitize.line_violations(tb.audit_lines(spark, d), ["doc_id"], forbidden=("project-x",))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Stage totals from the line items read as a stream, drained."""
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    target, checkpoint = scratch_path(spark, "totals"), scratch_path(spark, "stream")
    ingest.stream_stage_totals(tb.attempts_of(lines), target, checkpoint).awaitTermination()
    return ingest.read_stage_totals(spark, target, checkpoint)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Lines of several kinds by log and event, through the event scan."""
    return count_places(ll.read_back(spark, d, "application", "job", "stage", "sql"), ["log_id", "event"])


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    """Task attempts of lines that arrive in three batches of files."""
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "ingested")
    attempts = tb.attempts(spark, d).sortWithinPartitions("log_id")
    for arrival in range(3):
        # of the attempts, not of their lines, so that a line is made once
        arrived = tb.task_lines(attempts.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == arrival))
        ll.write_lines(arrived.withColumnRenamed("log_id", "app"), source)
        ingest.stream_event_lines(spark, source, target)
    events = ingest.read_event_lines(spark, target, folder_is_log=True).withColumn("log_id", F.regexp_extract("log_id", ll.LOG_FOLDER, 1))
    return ev.task_attempts(events).drop("seq")


def _graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.plan_graph_nodes(tb.plans(spark, d), tb.plan_metric_values(spark, d))


def _framed(spark: SparkSession, d: str) -> DataFrame:
    lines = decode_framed_files(tb.framed_files(spark, d))
    return lines.select(F.regexp_extract("name", r"_(\d+)\.", 1).cast("bigint").alias("l_orderkey"), "at", "value")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    """The place of every event file in its log, where places are not those of part numbers alone."""
    return el.ranked_files(tb.log_files(spark, d), roots=["/fleet"])


def _registered(spark: SparkSession, d: str) -> DataFrame:
    """A rule of the user's own among the built-in ones."""
    own = rules.Rule("long_tail", "stages", 20, "Stage %d has a long tail.", F.col("p99_duration_ms") > 2 * F.col("median_duration_ms"),
                     F.lit("low"), {"median": F.col("median_duration_ms"), "p99": F.col("p99_duration_ms")})
    listed = rules.register_rule(rules.built_in_rules(), own)
    table = _stages(spark, d, statistics=("duration_ms",), spread=False, reasons=False)
    found = fd.all_findings([r for r in listed if r.name == "long_tail"], stages=table)
    return found.select("log_id", "type", "severity", "stage_id", "message", "evidence")


def _result_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as results and read again."""
    path = scratch_path(spark, "results")
    state = _jobs(spark, d).drop("failed_seq")
    report.write_tables({"jobs": state, "completions": at.last_completion(tb.stage_events(spark, d))}, path)
    stages_read = spark.read.parquet(f"{path}/completions").select("log_id", F.col("stage_id").cast("bigint").alias("id"), "failure_reason")
    jobs_read = spark.read.parquet(f"{path}/jobs").select("log_id", F.col("job_id").cast("bigint").alias("id"), F.col("result"))
    return jobs_read.select("log_id", F.lit("job").alias("kind"), "id", F.col("result").alias("value")).unionByName(
        stages_read.select("log_id", F.lit("stage").alias("kind"), "id", F.col("failure_reason").alias("value")))


def all_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select(
        "log_id", "instance_id", "type", "severity", "stage_id", "execution_id", "message")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with its recommendation."""
    return plain(advise.recommend(_numbered(spark, d)))


QUERIES: dict[str, Query] = {
    "recognise_events": _recognise,
    "extract_fields": _extract,
    "validate_logs": lambda s, d: ev.validate_logs(tb.mixed_lines(s, d)),
    "task_success": _task_success,
    "task_attempts": _parsed_attempts,
    "application_events": lambda s, d: jobs.applications(tb.application_events(s, d)),
    "audit_application_starts": lambda s, d: sanitize.application_start_violations(tb.mixed_lines(s, d)),
    "scan_event_lines": _scanned,
    "parse_applications": lambda s, d: ev.application_events(ll.read_back(s, d, "application")).drop("seq"),
    "job_events": lambda s, d: ev.job_events(ll.read_back(s, d, "job")).drop("seq"),
    "job_stage_map": lambda s, d: ev.job_stage_map(ll.read_back(s, d, "job_stages")).drop("seq"),
    "stage_events": lambda s, d: ev.stage_events(ll.read_back(s, d, "stage")).drop("seq"),
    "stage_accumulables": lambda s, d: ev.stage_accumulables(ll.read_back(s, d, "accumulables")).drop("seq"),
    "sql_execution_events": lambda s, d: ev.sql_execution_events(ll.read_back(s, d, "sql")).drop("seq"),
    "driver_accum_updates": lambda s, d: ev.driver_accum_updates(ll.read_back(s, d, "driver")).drop("seq"),
    "stream_event_lines": _ingested,
    "late_attempt_rule": lambda s, d: ingest.latest_totals(_streamed(s, d)),
    "latest_stage_attempt": lambda s, d: _latest(s, d).select(*ATTEMPT),
    "stage_outcome": lambda s, d: at.stage_outcome(_latest(s, d), at.last_completion(tb.stage_events(s, d))),
    "stage_execution_asof": lambda s, d: _asof(s, d).drop("seq"),
    "accumulator_replay": lambda s, d: _replay(s, d).drop("seq", "pos"),
    "accumulator_union": _union,
    "sql_metric_values": lambda s, d: sqlexec.sql_metric_values(_replay(s, d)),
    "metric_lookup": lambda s, d: sqlexec.metric_lookup(flatten.plan_metrics(tb.plans(s, d)), tb.plan_metric_values(s, d)),
    "suppress_duplicates": _suppressed,
    "link_recommendations": _linked,
    "hotspot_inputs": _hotspot_inputs,
    "subtree_self_join": _members,
    "subtree_shape": _shape,
    "preorder_end": _ends,
    "summary_counts": _summary,
    "job_state": _job_state,
    "stage_details": lambda s, d: at.stage_details(tb.stage_events(s, d)),
    "successful_logical_tasks": lambda s, d: at.successful_logical_tasks(tb.attempts(s, d)).drop("seq"),
    "task_count": _task_count,
    "stage_duration_stats": _metric_columns("completed_tasks", "duration_samples", "duration_min_ms", "duration_max_ms",
                                            "duration_avg_ms"),
    "stage_shuffle_stats": _metric_columns("shuffle_samples", "shuffle_total_bytes", "shuffle_max_bytes"),
    "stage_spill_stats": _metric_columns("spill_samples", "memory_total_bytes", "disk_total_bytes", "memory_max_bytes",
                                         "disk_max_bytes"),
    "exact_median": lambda s, d: order_stats.order_statistics(_counts(s, d)).drop("p95", "p99"),
    "nearest_rank_percentile": lambda s, d: order_stats.order_statistics(_counts(s, d)).drop("median"),
    "sorted_samples": lambda s, d: order_stats.sorted_samples(_counts(s, d)),
    "failed_attempts": _failed_attempts,
    "speculative_attempts": _metric_columns("speculative_attempts", "speculative_ms"),
    "duplicate_successes": _metric_columns("duplicate_successes"),
    "executor_summary": _worker_query("executor"),
    "host_summary": _worker_query("host"),
    "heaviest_worker": lambda s, d: workers.heaviest_worker(_workers(s, d)).select(
        *ATTEMPT, "kind", "workers", "top.worker_id"),
    "sql_execution_merge": lambda s, d: _executions(s, d).drop("plan_json", "latest_plan_json", "first_seq", "replay_seq"),
    "sql_status": lambda s, d: _executions(s, d).select(
        *EXECUTION, sql_status(F.col("error_message"), F.col("end_ms")).alias("status")),
    "operator_counts": _operator_counts,
    "operator_categories": lambda s, d: sqlexec.operator_categories(sqlexec.operator_counts(_nodes(s, d))),
    "count_by_name": lambda s, d: sqlexec.count_by_name(_nodes(s, d), "Exchange"),
    "duplicate_subtrees": _duplicates,
    "severity_counts": lambda s, d: fd.severity_counts(_findings(s, d)),
    "issue_count_by_stage": lambda s, d: fd.issue_count_by_stage(_stage_findings(_stored_stages(s, d))),
    "top_bottlenecks": lambda s, d: fd.top_findings(_findings(s, d)).select("log_id", "rank", "type", "severity", "message"),
    "stage_hotspots": lambda s, d: fd.stage_hotspots(_hotspot_inputs(s, d)).select(
        *STAGE, "failed", "issues", "rank"),
    "bottleneck_instance_id": _instance_ids,
    "stage_first_seen": _first_seen,
    "last_completion": lambda s, d: at.last_completion(tb.stage_events(s, d)).drop("seq"),
    "all_bottlenecks": all_bottlenecks,
    "known_ids": lambda s, d: jobs.known_ids(tb.job_events(s, d), tb.stage_events(s, d), tb.attempts(s, d)),
    "recommendations": lambda s, d: advise.recommend(_numbered(s, d)).select(
        "log_id", "position", "recommendation_id", "severity", "type", "stage_id", "related_id"),
    "recommendation_text": _texts,
    "human_bytes": _scaled_bytes,
    "human_millis": _scaled_millis,
    "normalize_plan_text": lambda s, d: _nodes(s, d).select(
        *EXECUTION, "ord", normalize_plan_text(F.col("simple_string")).alias("normal_text")),
    "subtree_fingerprint": lambda s, d: subtrees.subtree_fingerprints(tb.plans(s, d)),
    "evidence_rows": _evidence,
    "plan_nodes_flatten": _flattened,
    "plan_graph_edges": lambda s, d: graph.plan_graph_edges(tb.plans(s, d)),
    "plan_graph_nodes": _graph_nodes,
    "report_rows": _report,
    "recommendation_report": _recommendation_report,
    "sql_execution_report": _sql_report,
    "sanitize_events": lambda s, d: sanitize.sanitize(tb.scrub_lines(s, d)),
    "sanitize_audit": _audit,
    "scan_compressed": _framed,
    "event_file_filter": lambda s, d: tb.log_files(s, d).select("path", el.is_event_file(F.col("name")).alias("holds_events")),
    "rolling_order": _rolling,
    "log_layout": lambda s, d: el.log_layout(tb.log_files(s, d), ["/fleet"]),
    "register_rule": _registered,
    "result_tables": _result_tables,
    "stream_stage_totals": _streamed,
    **{f"rule_{kind}": _rule(kind) for kind, *_ in advise.ADVICE},
}
