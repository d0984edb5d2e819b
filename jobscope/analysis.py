"""The whole analysis, from event lines to report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope import report
from jobscope.limits import DEFAULT_LIMITS, Limits
from jobscope.operators import advise, attempts as at
from jobscope.operators import findings as fd
from jobscope.operators import jobs, rules, sqlexec
from jobscope.operators.order_stats import sorted_samples, value_counts
from jobscope.operators.stages import stages
from jobscope.operators.workers import worker_summary, worker_totals
from jobscope.plans.flatten import flatten_plans, plan_nodes
from jobscope.plans.graph import plan_graph_edges, plan_graph_nodes
from jobscope.plans.subtrees import duplicate_subtrees
from jobscope.session import materialize
from jobscope.sources import events as ev


class InvalidLog(ValueError):
    """Raised in strict mode when a log cannot be analysed."""


def analyze(lines: DataFrame, *, limits: Limits = DEFAULT_LIMITS, extra_rules: list[rules.Rule] | None = None,
            strict: bool = False, layout: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables for the logs in ``lines``.

    Tables that several branches read are stored on the way: the recognised
    events (clustered by kind), the attempts and logical tasks, the stages,
    executions and plans, and the numbered findings.  ``layout`` (``log_layout``)
    sets logs aside whose files lie wrong.
    """
    # The text is read once.  Each task sorts what it has read by event, so a branch that wants few kinds skips the pages
    # of the others, and no more files are written than tasks have read.
    routed = materialize(ev.route_lines(lines).sortWithinPartitions("event"), "events")
    # Stored, so that its true size is known: events are then filtered without being shuffled
    # unless the list of unusable logs is too large to broadcast.
    validation = materialize(ev.validate_routed(routed, layout), "validation")
    if strict:
        bad = validation.where(F.col("status") != "ok").limit(1).collect()
        if bad:
            raise InvalidLog(f"{bad[0]['log_id']}: {bad[0]['status']}")
    events = ev.keep_valid(routed.where(F.col("event").isNotNull()), validation).select("log_id", "seq", "event", "value")

    attempts = materialize(ev.task_attempts(events), "attempts")
    stage_events = ev.stage_events(events)
    job_events = ev.job_events(events)
    tasks = materialize(at.logical_tasks(attempts), "tasks")
    stage_table = materialize(stages(attempts, stage_events, tasks=tasks), "stages")
    job_table = jobs.job_state(job_events)
    failed = jobs.failed_jobs(job_table)

    latest = at.latest_stage_attempt(at.seen_attempts(stage_events, attempts))
    replayed = sqlexec.replayed_completions(ev.job_stage_map(events), stage_events, attempts)
    updates = sqlexec.accumulator_replay(ev.driver_accum_updates(events), ev.stage_accumulables(events), replayed)
    values = sqlexec.sql_metric_values(updates)
    executions = materialize(sqlexec.sql_executions(ev.sql_execution_events(events), replayed), "executions")
    plans = materialize(flatten_plans(executions.select(
        *sqlexec.EXECUTION, F.coalesce("latest_plan_json", "plan_json").alias("plan_json"))), "plans")
    nodes = plan_nodes(plans)
    duplicates = duplicate_subtrees(plans)
    counts = sqlexec.operator_counts(nodes)

    rule_list = rules.built_in_rules(limits)
    for rule in extra_rules or []:
        rule_list = rules.register_rule(rule_list, rule)
    found = fd.all_findings(
        rule_list, stages=stage_table, failed_jobs=failed,
        executions=rules.execution_signals(executions, plans, duplicates, limits))
    found = materialize(fd.number_findings(found), "findings")
    advice = advise.recommend(found)
    metrics = at.stage_attempt_metrics(tasks)
    summary = jobs.summary_counts(
        events.select("log_id"), job_table, stage_table, at.tasks_without_stage(attempts), found)
    apps = jobs.applications(ev.application_events(events))
    of_latest = latest.select(*at.ATTEMPT)
    severities = fd.severity_counts(found)
    hotspots = fd.stage_hotspots(fd.hotspot_inputs(stage_table, found))
    workers = worker_summary(worker_totals(tasks, at.worker_names(attempts)), metrics).join(of_latest, [*at.ATTEMPT], "left_semi")
    samples = sorted_samples(value_counts(tasks)).join(of_latest, [*at.ATTEMPT], "left_semi")
    return {
        "log_validation": validation,
        "applications": apps,
        "summary": summary,
        "jobs": job_table,
        "failed_jobs": failed,
        "stages": stage_table,
        "workers": workers,
        "samples": samples,
        "sql_executions": executions,
        "sql_metric_values": values,
        "operator_counts": counts,
        "duplicate_subtrees": duplicates,
        "plan_graph_nodes": plan_graph_nodes(plans, values),
        "plan_graph_edges": plan_graph_edges(plans),
        "findings": found,
        "recommendations": advice,
        "severity_counts": severities,
        "top_findings": fd.top_findings(found),
        "hotspots": hotspots,
        "report": report.report_rows(apps, summary, stage_table, executions, counts, failed, found, advice,
                                     workers, samples),
        "recommendation_report": report.recommendation_report(apps, summary, severities, hotspots, advice, found),
        "sql_report": report.sql_execution_report(
            executions, counts, sqlexec.operator_categories(counts), duplicates),
    }
