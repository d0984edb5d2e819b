"""Independent SQL for every registered query, over the stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from jobscope import report
from jobscope.operators import advise
from jobscope.sources import tables as tb

K = "log_id, stage_id, stage_attempt_id"
MILLIS = "epoch_ms(o_orderdate)"
MIB = 1048576
GIB = 1024 * MIB


def _cols(columns: Mapping[str, str]) -> str:
    return ", ".join(f"{e.format(div='//', millis=MILLIS)} as {n}" for n, e in columns.items())


def _line_view(columns: Mapping[str, str], slot: int, where: str = "true") -> str:
    return f"select {_cols(columns)}, rn + {slot} as seq from b where {where}"


_SQL_METADATA = "l_returnflag <> 'N' and l_partkey % 4 <> 0"

def _zero(*names: str) -> str:
    return ", ".join(f"coalesce({n}, 0) as {n}" for n in names)


CTE: dict[str, str] = {
    "b": f"select *, {_cols(tb.LINE_BASE)}, 4 * row_number() over (order by l_orderkey, l_linenumber, l_partkey, "
         "cast(round(l_extendedprice * 100) as bigint)) as rn from lineitem",
    "attempts": _line_view(tb.ATTEMPTS, tb.TASK_SLOT),
    "stage_events": f"select * from ({_line_view(tb.STAGE_EVENTS, tb.STAGE_SLOT)}) where stage_id is not null",
    "job_stages": f"select * from ({_line_view(tb.JOB_STAGES, tb.JOB_START_SLOT)}) "
                  "where stage_id is not null and execution_id is not null",
    "stage_values": f"select * from ({_line_view(tb.STAGE_VALUES, tb.STAGE_SLOT, _SQL_METADATA)}) where stage_id is not null",
    "driver_values": _line_view(tb.DRIVER_VALUES, tb.DRIVER_SLOT),
    "ok": f"select *, row_number() over (partition by {K}, task_index order by seq) as nth from attempts "
          "where success and stage_id is not null and task_index is not null",
    "firsts": "select * from ok where nth = 1",
    "failed_tasks": "select * from attempts where not success and stage_id is not null",
    "done": f"select {K}, count(*) as completed_tasks, count(duration_ms) as duration_samples, "
            "cast(sum(duration_ms) as bigint) as duration_total_ms, min(duration_ms) as duration_min_ms, "
            "max(duration_ms) as duration_max_ms, cast(sum(duration_ms) // count(duration_ms) as bigint) as duration_avg_ms, "
            "count(shuffle_read_bytes) as shuffle_samples, "
            "cast(coalesce(sum(shuffle_read_bytes), 0) as bigint) as shuffle_total_bytes, "
            "max(shuffle_read_bytes) as shuffle_max_bytes, count(memory_bytes_spilled) as spill_samples, "
            "cast(coalesce(sum(memory_bytes_spilled), 0) as bigint) as memory_total_bytes, "
            "cast(coalesce(sum(disk_bytes_spilled), 0) as bigint) as disk_total_bytes, "
            "max(memory_bytes_spilled) as memory_max_bytes, max(disk_bytes_spilled) as disk_max_bytes "
            f"from firsts group by {K}",
    "extra": f"select {K}, count(*) filter (where speculative) as speculative_attempts, "
             "cast(coalesce(sum(duration_ms) filter (where speculative), 0) as bigint) as speculative_ms, "
             f"count(*) filter (where nth > 1) as duplicate_successes from ok group by {K}",
    # Stage attempts of which a task ended, completed or not.
    "tried": f"select distinct {K} from attempts where stage_id is not null",
    "broken": f"select {K}, count(*) as failed_attempts, cast(coalesce(sum(duration_ms), 0) as bigint) as failed_ms "
              f"from failed_tasks group by {K}",
    "reasons": f"select {K}, reason, min(seq) as first_seq from failed_tasks group by {K}, reason",
    "attempt_reasons": f"select {K}, string_agg(reason, ',' order by first_seq) as attempt_reasons from reasons group by {K}",
    "all_reasons": "select log_id, stage_id, string_agg(reason, ',' order by s) as all_reasons from (select log_id, "
                   "stage_id, reason, min(first_seq) as s from reasons group by all) group by log_id, stage_id",
    "seen": f"select {K}, min(seq) as first_seq from (select {K}, seq from attempts where stage_id is not null "
            f"union all select {K}, seq from stage_events) group by {K}",
    "latest": "select log_id, stage_id, max(stage_attempt_id) as stage_attempt_id, min(first_seq) as first_seq "
              "from seen group by log_id, stage_id",
    "details": f"select {K}, stage_name, num_tasks from (select *, row_number() over (partition by {K} order by seq desc) "
               "as nth from stage_events) where nth = 1",
    "completions": f"select {K}, seq, stage_name, num_tasks, failure_reason from (select *, row_number() over "
                   f"(partition by {K} order by seq desc) as nth from stage_events where kind = 'completed') where nth = 1",
    "outcome": f"select l.log_id, l.stage_id, l.stage_attempt_id, c.stage_name, c.failure_reason, "
               "case when c.seq is null then 'unknown' when c.failure_reason is null then 'completed' else 'failed' end "
               "as outcome from latest l left join completions c using (log_id, stage_id, stage_attempt_id)",
    "samples": " union all ".join(
        f"select {K}, '{m}' as metric, {m} as value from firsts where {m} is not null"
        for m in ("duration_ms", "shuffle_read_bytes", "memory_bytes_spilled", "disk_bytes_spilled")),
    "ranked": f"select *, row_number() over (partition by {K}, metric order by value) as r, "
              f"count(*) over (partition by {K}, metric) as n from samples",
    "stats": f"select {K}, metric, lo + (hi - lo) // 2 as median, p95, p99 from (select {K}, metric, "
             "max(value) filter (where r = (n + 1) // 2) as lo, max(value) filter (where r = n // 2 + 1) as hi, "
             "max(value) filter (where r = least(n, greatest(1, ceil(0.95::double * n)))) as p95, "
             "max(value) filter (where r = least(n, greatest(1, ceil(0.99::double * n)))) as p99 "
             f"from ranked group by {K}, metric)",
    "wide_stats": f"select {K}, " + ", ".join(
        f"max({s}) filter (where metric = '{m}') as {s}_{m}"
        for m in ("duration_ms", "shuffle_read_bytes", "memory_bytes_spilled", "disk_bytes_spilled")
        for s in ("median", "p95", "p99")) + f" from stats group by {K}",
    "worker_totals": " union all ".join(
        f"select {K}, '{kind}' as kind, {col} as worker_id, count(*) as task_count, "
        "cast(sum(duration_ms) as bigint) as duration_ms, min(seq) as first_seq from firsts "
        f"where duration_ms is not null and trim({col}) <> '' group by {K}, {col}"
        for kind, col in (("executor", "executor_id"), ("host", "host"))),
    "workers": f"select w.*, round(w.task_count::double / d.completed_tasks, 4) as task_share, "
               "round(w.duration_ms::double / d.duration_total_ms, 4) as duration_share from worker_totals w "
               "join done d using (log_id, stage_id, stage_attempt_id) where d.duration_total_ms <> 0",
    "heaviest": f"select *, count(*) over (partition by {K}, kind) as workers, row_number() over "
                f"(partition by {K}, kind order by duration_ms desc, first_seq) as nth from workers",
    "stages": "select l.log_id, l.stage_id, l.stage_attempt_id, l.first_seq, t.stage_name, t.num_tasks, "
              "o.stage_name as done_name, o.failure_reason, o.outcome, "
              + ", ".join(f"coalesce(d.{c}, 0) as {c}" for c in (
                  "completed_tasks", "duration_samples", "shuffle_samples", "shuffle_total_bytes",
                  "memory_total_bytes", "disk_total_bytes"))
              + ", d.duration_min_ms, d.duration_max_ms, d.duration_avg_ms, d.duration_total_ms, d.shuffle_max_bytes, "
                "d.memory_max_bytes, d.disk_max_bytes, w.* exclude (log_id, stage_id, stage_attempt_id), "
              + ", ".join(f"coalesce(e.{c}, 0) as {c}" for c in (
                  "speculative_attempts", "speculative_ms", "duplicate_successes"))
              + ", coalesce(f.failed_attempts, 0) as failed_attempts, coalesce(f.failed_ms, 0) as failed_ms, "
                "coalesce(a.n, 0) as all_failed_attempts, coalesce(a.ms, 0) as all_failed_ms, "
                "coalesce(r.attempt_reasons, '') as attempt_reasons, coalesce(ar.all_reasons, '') as all_reasons, "
              + ", ".join(f"{alias}.{c} as {kind}_{c}" for alias, kind in (("x", "executor"), ("h", "host")) for c in (
                  "workers", "worker_id", "task_count", "duration_ms", "task_share", "duration_share"))
              + " from latest l left join details t using (log_id, stage_id, stage_attempt_id) "
                "left join outcome o using (log_id, stage_id, stage_attempt_id) "
                "left join done d using (log_id, stage_id, stage_attempt_id) "
                "left join wide_stats w using (log_id, stage_id, stage_attempt_id) "
                "left join extra e using (log_id, stage_id, stage_attempt_id) "
                "left join broken f using (log_id, stage_id, stage_attempt_id) "
                "left join attempt_reasons r using (log_id, stage_id, stage_attempt_id) "
                "left join (select log_id, stage_id, sum(failed_attempts)::bigint as n, sum(failed_ms)::bigint as ms "
                "from broken group by all) a using (log_id, stage_id) "
                "left join all_reasons ar using (log_id, stage_id) "
                "left join (select * from heaviest where nth = 1 and kind = 'executor') x "
                "using (log_id, stage_id, stage_attempt_id) "
                "left join (select * from heaviest where nth = 1 and kind = 'host') h "
                "using (log_id, stage_id, stage_attempt_id)",
    "asof_": "select c.log_id, c.stage_id, c.stage_attempt_id, c.seq, j.execution_id from "
            "(select * from stage_events where kind = 'completed') c asof left join job_stages j "
            "on c.log_id = j.log_id and c.stage_id = j.stage_id and c.seq >= j.seq",
    "replayed": "select a.* from completions c join latest l using (log_id, stage_id, stage_attempt_id) "
                "join asof_ a using (log_id, stage_id, stage_attempt_id, seq) "
                "where c.failure_reason is null and a.execution_id is not null",
    "replay": "select log_id, execution_id, seq, accumulator_id, value, 'driver' as source from driver_values union all "
              "select r.log_id, r.execution_id, v.seq, v.accumulator_id, v.value, 'stage' from stage_values v "
              "join replayed r using (log_id, stage_id, stage_attempt_id, seq)",
    "job_events": f"select {_cols(tb.JOB_EVENTS)}, o_orderkey as seq from orders",
    "job_last": "select log_id, job_id, max(seq) filter (where kind = 'end' and result = 'JobSucceeded') as won, "
                "max(seq) filter (where kind = 'end') as ended from job_events group by all",
    "jobs": "select j.log_id, j.job_id, e.result, case when j.ended is null then 'running' when "
            "e.result = 'JobSucceeded' then 'completed' else 'failed' end as state, (select min(seq) from job_events x "
            "where x.log_id = j.log_id and x.job_id = j.job_id and x.kind = 'end' and x.seq > coalesce(j.won, -1)) "
            "as failed_seq from job_last j left join job_events e on e.log_id = j.log_id and e.job_id = j.job_id "
            "and e.seq = j.ended",
    "sql_events": f"select {_cols(tb.SQL_EVENTS)}, o_orderkey as seq from orders",
    "executions": "select g.log_id, g.execution_id, s.root_execution_id, s.description, s.details, s.time_ms as start_ms, "
                  "e.time_ms as end_ms, e.time_ms - s.time_ms as duration_ms, s.plan_description, "
                  "d.plan_description as latest_plan_description, e.error_message, g.first_seq from (select log_id, "
                  "execution_id, min(seq) as first_seq, max(seq) filter (where kind = 'start') as started, "
                  "max(seq) filter (where kind = 'end') as ended, max(seq) filter (where kind = 'start' or "
                  "(kind = 'update' and plan_description is not null)) as planned from sql_events group by all) g "
                  "left join sql_events s on s.seq = g.started left join sql_events e on e.seq = g.ended "
                  "left join sql_events d on d.seq = g.planned",
    "branches": "select concat('app-', cast((o_orderkey // 8) % 4 as string)) as log_id, o_orderkey // 8 as execution_id, "
                "row_number() over (partition by o_orderkey // 8 order by o_orderkey) - 1 as i, o_orderkey as k, "
                "o_orderstatus as status, o_orderpriority as priority, case o_orderstatus when 'F' then 'Exchange' "
                "when 'O' then 'BroadcastExchange' else 'Sort' end as name from orders",
    "nodes": "select distinct log_id, execution_id, 0 as ord, 1 as depth, 'AdaptiveSparkPlan' as node_name, "
             "'AdaptiveSparkPlan isFinalPlan=true' as simple_string from branches union all "
             "select distinct log_id, execution_id, 1, 2, 'Union', 'Union' from branches union all "
             "select log_id, execution_id, 3 * i + 2, 3, name, concat(name, ' hashpartitioning(k#', k, 'L, 4), [plan_id=', "
             "k, ']') from branches union all "
             "select log_id, execution_id, 3 * i + 3, 4, 'HashAggregate', concat('HashAggregate(keys=[k#', k, "
             "'L], functions=[count(1)]) [codegen id : ', i + 1, ']') from branches union all "
             "select log_id, execution_id, 3 * i + 4, 5, 'Scan parquet', concat('FileScan parquet [k#', k, "
             "'L] PushedFilters: [', case when k % 2 = 0 then concat('IsNotNull(k), In(p, [', priority, ',x])') else "
             "concat('In(p, [', priority, ',x]), IsNotNull(k)') end, '], ReadSchema: struct<k:bigint>') from branches",
    "ends": "select r.log_id, r.execution_id, r.ord, min(d.ord) as next_ord from nodes r join nodes d on "
            "r.execution_id = d.execution_id and d.ord > r.ord and d.depth <= r.depth group by all",
    "spans": "select n.*, coalesce(e.next_ord, max(n.ord) over (partition by n.execution_id) + 1) as end_ord from nodes n "
             "left join ends e using (log_id, execution_id, ord)",
    "normal": r"""select *, case when node_name = 'Scan parquet' then regexp_replace(regexp_replace(simple_string,
        'PushedFilters: \[IsNotNull\(k\), (In\(p, \[[^\]]*\]\))\]', 'PushedFilters: [\1, IsNotNull(k)]'), '#\d+L?', '', 'g')
        else trim(regexp_replace(regexp_replace(regexp_replace(simple_string, '#\d+L?', '', 'g'), '\s*\[plan_id=\d+\]', '', 'g'),
        '\s*\[codegen id\s*:\s*\d+\]|codegen id\s*:\s*\d+', '', 'g')) end as normal_text from spans""",
    "members": "select r.log_id, r.execution_id, r.ord as root_ord, r.depth as root_depth, r.node_name as root_name, d.ord, "
               "d.depth, d.node_name, d.node_name || '|' || d.normal_text || '|[' as token, lag(d.depth) over "
               "(partition by r.execution_id, r.ord order by d.ord) as before from normal r join normal d on "
               "r.execution_id = d.execution_id and d.ord >= r.ord and d.ord < r.end_ord",
    "shapes": "select log_id, execution_id, root_ord as ord, any_value(root_name) as root, count(*) as subtree_size, "
              "max(depth) - min(depth) + 1 as subtree_depth, string_agg(distinct node_name, ',' order by node_name) "
              "as operators, string_agg(case when before is null or depth > before then '' else "
              "repeat(']', before - depth + 1) || ',' end || token, '' order by ord) || "
              "repeat(']', arg_max(depth, ord) - min(depth) + 1) as fingerprint from members group by log_id, execution_id, root_ord",
    "duplicates": "select log_id, execution_id, fingerprint, arg_min(root, ord) as root, count(*) as count, "
                  "arg_min(subtree_size, ord) as subtree_size, arg_min(subtree_depth, ord) as subtree_depth, "
                  "arg_min(operators, ord) as operators, min(ord) as first_ord from shapes "
                  "group by log_id, execution_id, fingerprint having count(*) >= 2",
    "telling": "select *, (select string_agg(x, ',' order by x) from (select unnest(string_split(operators, ',')) as x) "
               "where regexp_matches(x, 'Exchange|Join|Aggregate|Sort|Scan')) as interesting from duplicates",
    "large": "select * from telling where subtree_size >= 3",
    "top_repeated": "select *, count(*) over (partition by execution_id) as groups_, row_number() over (partition by "
                    "execution_id order by subtree_size desc, count desc, subtree_depth desc, root, first_ord) as nth "
                    "from large where interesting is not null",
    "top_exchange": "select *, count(*) over (partition by execution_id) as groups_, row_number() over (partition by "
                    "execution_id order by subtree_size desc, count desc, subtree_depth desc, root, first_ord) as nth "
                    "from large where root = 'Exchange'",
    "exchange_counts": "select log_id, execution_id, count(*) as exchange_count from nodes where node_name = 'Exchange' group by all",
    "plan_values": f"select log_id, execution_id, accumulator_id, arg_max(value, seq) as value from "
                   f"(select {_cols(tb.PLAN_VALUES)}, o_orderkey as seq from orders) group by all",
    "app_events": f"select {_cols(tb.APPLICATION_EVENTS)}, o_orderkey as seq from orders",
}

_NEEDS: dict[str, list[str]] = {}


def _needs(name: str) -> list[str]:
    """CTEs mentioned by ``name``, dependencies first."""
    import re

    if name not in _NEEDS:
        _NEEDS[name] = []
        words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", CTE[name])))
        for other in CTE:
            if other != name and other in words:
                for need in [*_needs(other), other]:
                    if need not in _NEEDS[name]:
                        _NEEDS[name].append(need)
    return _NEEDS[name]


def with_ctes(body: str, *more: tuple[str, str]) -> str:
    """``body`` behind the CTEs it uses."""
    import re

    text = " ".join([body, *[m[1] for m in more]])
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", text)))
    order: list[str] = []
    for name in CTE:
        if name in words:
            for need in [*_needs(name), name]:
                if need not in order:
                    order.append(need)
    parts = [f"{n} as ({CTE[n]})" for n in order] + [f"{n} as ({sql})" for n, sql in more]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


# Rules, written out a second time.
STAGE_MSG = "'Stage ' || stage_id || ' {}'"
SHUFFLE_AVG = "(case when shuffle_samples > 0 then shuffle_total_bytes // shuffle_samples else 0 end)"
SKEWED = (f"coalesce(shuffle_samples >= 10 and median_shuffle_read_bytes > 0 and shuffle_max_bytes > {256 * MIB} "
          "and shuffle_max_bytes > 5.0 * median_shuffle_read_bytes, false)")
STARVED = f"(shuffle_total_bytes >= {10 * GIB} and shuffle_samples <= 15)"
SHARE = "round(speculative_attempts::double / completed_tasks, 4)"


def _level(high: str) -> str:
    return f"case when {high} then 'high' else 'medium' end"


def _spill(kind: str, label: str, threshold: int) -> tuple:
    middle, top = f"median_{kind}_bytes_spilled", f"{kind}_max_bytes"
    return (f"completed_tasks >= 10 and {middle} > 0 and {top} > {threshold} and {top} > 5.0 * {middle}",
            "'medium'" if kind == "memory" else "'high'",
            {"completedTasks": "completed_tasks", f"medianTask{label}BytesSpilled": middle,
             f"p95Task{label}BytesSpilled": f"p95_{kind}_bytes_spilled", f"maxTask{label}BytesSpilled": top,
             "skewRatio": f"round({top}::double / {middle}, 2)", "thresholdBytes": str(threshold)},
            f"has {kind} spill skew.", 6, 0 if kind == "memory" else 1)


def _imbalance(kind: str, key: str) -> tuple:
    return (f"completed_tasks >= 10 and {kind}_workers >= 2 and {kind}_duration_share >= 0.75 and {kind}_task_share >= 0.5",
            "'medium'",
            {"completedTasks": "completed_tasks", f"{kind}Count": f"{kind}_workers", key: f"{kind}_worker_id",
             "workerTaskCount": f"{kind}_task_count", "workerTaskDurationMillis": f"{kind}_duration_ms",
             "workerTaskShare": f"{kind}_task_share", "workerDurationShare": f"{kind}_duration_share",
             "minDurationShare": "0.75::double", "minTaskShare": "0.5::double"},
            f"has {kind} imbalance.", 10, 0 if kind == "executor" else 1)


STAGE_RULES = {
    "task_duration_skew": (
        "duration_samples = completed_tasks and completed_tasks >= 10 and duration_avg_ms > 0 "
        "and duration_max_ms >= 3.0 * duration_avg_ms", "'medium'",
        {"completedTasks": "completed_tasks", "avgTaskDurationMillis": "duration_avg_ms",
         "maxTaskDurationMillis": "duration_max_ms",
         "skewRatio": "round(duration_max_ms::double / duration_avg_ms, 2)"}, "has task duration skew.", 1, 0),
    "shuffle_partition_skew": (
        SKEWED, "'high'",
        {"shuffleReadingTasks": "shuffle_samples", "medianTaskShuffleReadBytes": "median_shuffle_read_bytes",
         "maxTaskShuffleReadBytes": "shuffle_max_bytes",
         "skewRatio": "round(shuffle_max_bytes::double / median_shuffle_read_bytes, 2)",
         "thresholdBytes": str(256 * MIB)}, "has shuffle partition skew.", 2, 0),
    "oversized_shuffle_partitions": (
        f"shuffle_samples >= 2 and not {SKEWED} and (p95_shuffle_read_bytes >= {256 * MIB} or shuffle_max_bytes >= {2 * GIB})",
        _level(f"p95_shuffle_read_bytes >= {GIB} or shuffle_max_bytes >= {2 * GIB}"),
        {"shuffleReadingTasks": "shuffle_samples", "medianTaskShuffleReadBytes": "median_shuffle_read_bytes",
         "p95TaskShuffleReadBytes": "p95_shuffle_read_bytes", "maxTaskShuffleReadBytes": "shuffle_max_bytes",
         "mediumP95ShuffleReadThresholdBytes": str(256 * MIB), "highP95ShuffleReadThresholdBytes": str(GIB),
         "highMaxShuffleReadThresholdBytes": str(2 * GIB)}, "has oversized shuffle partitions.", 3, 0),
    "low_shuffle_parallelism": (
        f"shuffle_samples > 0 and shuffle_total_bytes >= {GIB} and ({STARVED} or ({SHUFFLE_AVG} < {256 * MIB} "
        "and shuffle_samples <= 7))", _level(STARVED),
        {"shuffleReadingTasks": "shuffle_samples", "shuffleReadBytes": "shuffle_total_bytes",
         "avgTaskShuffleReadBytes": SHUFFLE_AVG, "mediumTotalShuffleReadThresholdBytes": str(GIB),
         "highTotalShuffleReadThresholdBytes": str(10 * GIB), "mediumMaxShuffleReadingTasks": "7",
         "highMaxShuffleReadingTasks": "15"}, "has low shuffle parallelism.", 4, 0),
    "spill_pressure": (
        f"(completed_tasks = 1 and (disk_total_bytes >= {GIB} or memory_total_bytes >= {4 * GIB})) or "
        f"(completed_tasks >= 2 and (disk_total_bytes >= {256 * MIB} or memory_total_bytes >= {GIB}))",
        _level(f"disk_total_bytes >= {GIB} or coalesce(disk_max_bytes, 0) >= {512 * MIB}"),
        {"completedTasks": "completed_tasks", "memoryBytesSpilled": "memory_total_bytes",
         "diskBytesSpilled": "disk_total_bytes", "maxTaskMemoryBytesSpilled": "memory_max_bytes",
         "maxTaskDiskBytesSpilled": "disk_max_bytes", "mediumMemorySpillThresholdBytes": str(GIB),
         "mediumDiskSpillThresholdBytes": str(256 * MIB), "highDiskSpillThresholdBytes": str(GIB),
         "highMaxTaskDiskSpillThresholdBytes": str(512 * MIB)}, "has spill pressure.", 5, 0),
    "memory_spill_skew": _spill("memory", "Memory", 256 * MIB),
    "disk_spill_skew": _spill("disk", "Disk", 128 * MIB),
    "too_many_tiny_tasks": (
        "duration_samples = completed_tasks and completed_tasks >= 100 and duration_avg_ms <= 500 and "
        f"p95_duration_ms <= 1000 and (shuffle_samples = 0 or {SHUFFLE_AVG} <= {MIB})", "'medium'",
        {"completedTasks": "completed_tasks", "avgTaskDurationMillis": "duration_avg_ms",
         "p95TaskDurationMillis": "p95_duration_ms", "avgTaskShuffleReadBytes": SHUFFLE_AVG,
         "minCompletedTasks": "100", "maxAvgTaskDurationMillis": "500", "maxP95TaskDurationMillis": "1000",
         "maxAvgShuffleReadBytes": str(MIB)}, "has too many tiny tasks.", 7, 0),
    "retry_waste": (
        "all_failed_attempts >= 3 and all_failed_ms >= 30000", _level("all_failed_ms >= 300000"),
        {"failedTaskAttempts": "all_failed_attempts", "failedTaskAttemptDurationMillis": "all_failed_ms",
         "failedTaskAttemptReasons": "all_reasons", "minFailedTaskAttempts": "3",
         "mediumFailedAttemptDurationMillis": "30000", "highFailedAttemptDurationMillis": "300000"},
        "has retry waste from failed task attempts.", 8, 0),
    "speculation_heavy": (
        f"completed_tasks >= 10 and speculative_attempts >= 3 and {SHARE} >= 0.2", _level(f"{SHARE} >= 0.5"),
        {"completedTasks": "completed_tasks", "speculativeTaskAttempts": "speculative_attempts",
         "duplicateSuccessfulTaskAttempts": "duplicate_successes",
         "speculativeTaskAttemptDurationMillis": "speculative_ms", "speculativeAttemptShare": SHARE,
         "minCompletedTasks": "10", "minSpeculativeTaskAttempts": "3",
         "mediumSpeculativeAttemptShare": "0.2::double", "highSpeculativeAttemptShare": "0.5::double"},
        "has heavy speculative execution.", 9, 0),
    "executor_imbalance": _imbalance("executor", "executorId"),
    "host_imbalance": _imbalance("host", "host"),
    "failed_stage": (
        "outcome = 'failed'", "'high'",
        {"stageId": "stage_id", "stageName": "coalesce(done_name, 'unknown')",
         "failureReason": "coalesce(nullif(trim(failure_reason), ''), 'unknown')",
         "failedTaskAttempts": "failed_attempts", "failedTaskAttemptDurationMillis": "failed_ms",
         "failedTaskAttemptReasons": "attempt_reasons"}, "failed.", 15, 0),
}


def _description(alias: str) -> str:
    return f"coalesce({alias}.description, 'unknown')"


_TOP = ("t.root as \"topDuplicateRoot\", t.count as \"topDuplicateCount\", t.subtree_size as \"topDuplicateSubtreeSize\", "
        "t.subtree_depth as \"topDuplicateMaxDepth\", t.interesting as \"topDuplicateInterestingOperators\"")
PLAN_RULES = {
    "sql_many_exchanges": (
        "select e.log_id, 'medium' as severity, e.execution_id as \"sqlExecutionId\", e.exchange_count as \"exchangeCount\", "
        f"4 as \"minExchangeOperators\", {_description('x')} as description from exchange_counts e "
        "join executions x using (log_id, execution_id) where e.exchange_count >= 4",
        "has many exchange operators.", 11),
    "duplicate_sql_subtree": (
        "select t.log_id, 'medium' as severity, t.execution_id as \"sqlExecutionId\", "
        f"{_description('x')} as description, t.groups_ as \"duplicateGroups\", {_TOP} from top_repeated t "
        "join executions x using (log_id, execution_id) where t.nth = 1 and t.execution_id not in "
        "(select execution_id from top_exchange)",
        "has repeated physical plan subtrees.", 12),
    "possible_missed_exchange_reuse": (
        "select t.log_id, 'medium' as severity, t.execution_id as \"sqlExecutionId\", "
        f"{_description('x')} as description, t.groups_ as \"duplicateExchangeGroups\", {_TOP}, 'low' as confidence, "
        "'physical-plan-only signal' as \"confidenceReason\", "
        "'Validate in Spark UI and query code before making optimizer conclusions.' as \"validationRequired\" "
        "from top_exchange t join executions x using (log_id, execution_id) where t.nth = 1",
        "has repeated exchange-like physical plan subtrees.", 13),
}


def stage_rule_sql(name: str) -> str:
    where, severity, evidence, *_ = STAGE_RULES[name]
    key = "" if "stageId" in evidence else "stage_id, "
    return with_ctes(f"select log_id, {key}{severity} as severity, "
                     + ", ".join(f'{v} as "{k}"' for k, v in evidence.items()) + f" from stages where {where}")


def _finding_parts() -> list[str]:
    parts = []
    for name, (where, severity, _e, message, order, part) in STAGE_RULES.items():
        parts.append(f"select log_id, '{name}' as type, {severity} as severity, stage_id, null::bigint as execution_id, "
                     f"{STAGE_MSG.format(message)} as message, {order} as rule_order, {part} as rule_part, first_seq, "
                     f"null::bigint as job_id from stages where {where}")
    for name, (sql, message, order) in PLAN_RULES.items():
        parts.append(f"select r.log_id, '{name}' as type, r.severity, -1 as stage_id, r.\"sqlExecutionId\" as execution_id, "
                     f"'SQL execution ' || r.\"sqlExecutionId\" || ' {message}' as message, {order} as rule_order, "
                     f"0 as rule_part, x.first_seq, null::bigint as job_id from ({sql}) r join executions x on "
                     "x.log_id = r.log_id and x.execution_id = r.\"sqlExecutionId\"")
    parts.append("select log_id, 'failed_job' as type, 'high' as severity, -1 as stage_id, null::bigint as execution_id, "
                 "'Job ' || job_id || ' failed.' as message, 14 as rule_order, 0 as rule_part, failed_seq as first_seq, "
                 "job_id from jobs where state = 'failed'")
    return parts


FINDINGS = ("findings", " union all ".join(_finding_parts()))
STAGE_FINDINGS = ("findings", " union all ".join(_finding_parts()[:len(STAGE_RULES)]))
NUMBERED = ("numbered", "select *, row_number() over (partition by log_id order by rule_order, first_seq, rule_part) as position "
                        "from findings")


SUMMARY = ("summary", "select a.log_id, coalesce(j.jobs, 0) as jobs, coalesce(j.c, 0) as jobs_completed, coalesce(j.f, 0) as jobs_failed, "
               "coalesce(s.n, 0) as stages, coalesce(s.c, 0) as stages_completed, coalesce(s.f, 0) as stages_failed, "
               "coalesce(s.t, 0) + coalesce(l.n, 0) as tasks, coalesce(i.n, 0) as issues from "
               "(select distinct log_id from attempts) a "
               "left join (select log_id, count(*) as jobs, count(*) filter (where state = 'completed') as c, "
               "count(*) filter (where state = 'failed') as f from jobs group by all) j using (log_id) "
               "left join (select log_id, count(*) as n, count(*) filter (where outcome = 'completed') as c, "
               "count(*) filter (where outcome = 'failed') as f, sum(completed_tasks)::bigint as t from stages group by all) s "
               "using (log_id) left join (select log_id, count(distinct task_id) as n from attempts where success and "
               "(stage_id is null or task_index is null) group by all) l using (log_id) "
               "left join (select log_id, count(*) as n from findings group by all) i using (log_id)")
SEVERITIES = ("severities", "select *, concat_ws(', ', case when high > 0 then 'high=' || high end, case when medium > 0 then 'medium=' || medium "
            "end) as summary from (select log_id, count(*) filter (where severity = 'high') as high, count(*) filter "
            "(where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from findings group by all)")
APPLICATIONS = ("applications", "select g.log_id, s.app_id, s.app_name, s.time_ms as start_ms, e.time_ms as end_ms, "
            "e.time_ms - s.time_ms as duration_ms from (select log_id, max(seq) filter (where is_start) as started, "
            "max(seq) filter (where not is_start) as ended from app_events group by all) g "
            "left join app_events s on s.seq = g.started left join app_events e on e.seq = g.ended")
HOTSPOTS = ("hotspots", "select * from (select *, row_number() over (partition by log_id order by failed desc, issues desc, "
            "coalesce(duration_max_ms, 0) desc, shuffle_total_bytes desc, memory_total_bytes + disk_total_bytes desc, stage_id) as rank "
            "from (select s.*, s.outcome = 'failed' as failed, coalesce(i.n, 0) as issues from stages s left join (select log_id, stage_id, "
            "count(*) as n from findings where stage_id >= 0 group by all) i using (log_id, stage_id)) where failed or issues > 0 or "
            "duration_max_ms > 0 or shuffle_total_bytes > 0 or memory_total_bytes + disk_total_bytes > 0) where rank <= 5")


def findings_sql(body: str, *more: tuple[str, str]) -> str:
    return with_ctes(body, FINDINGS, NUMBERED, *more)


def _number(x: str, unit: int, label: str) -> str:
    return f"regexp_replace(format('{{:,.1f}}', {x}::double / {unit}), '\\.0$', '') || ' {label}'"


def human_bytes(x: str) -> str:
    return (f"case when {x} < 1024 then {x} || ' B' when {x} < {MIB} then {_number(x, 1024, 'KiB')} when {x} < {GIB} then "
            f"{_number(x, MIB, 'MiB')} when {x} < {1024 * GIB} then {_number(x, GIB, 'GiB')} else {_number(x, 1024 * GIB, 'TiB')} end")


def human_millis(x: str) -> str:
    return (f"case when {x} < 1000 then {x} || ' ms' when {x} < 60000 then {_number(x, 1000, 's')} when {x} < 3600000 then "
            f"{_number(x, 60000, 'min')} else {_number(x, 3600000, 'hr')} end")


RECOMMENDATION_ID = "case type " + " ".join(f"when '{t}' then '{r}'" for t, r, _, _ in advise.ADVICE) + " end"


_METRIC_VALUES = (
    "select m.*, v.value from (select log_id, execution_id, 3 * i + 2 as ord, pos, metric_name, acc as accumulator_id, "
    "metric_type from branches, (values (0, 'data size', 10, 'size'), (1, null, 7, 'sum'), "
    "(2, 'shuffle write time', 7, 'nsTiming'), (3, 'fetch wait time', 6, 'timing'), (4, 'records', 5, 'sum'), "
    "(5, 'spill size', 4, 'size'), (6, 'peak memory', 3, 'size')) as t(pos, metric_name, modulus, metric_type), "
    "lateral (select k % modulus as acc)) m left join plan_values v using (log_id, execution_id, accumulator_id)")

_NUMBER = "try_cast(case when regexp_full_match(value, '[+-]?[0-9]+') then value end as bigint)"


def _sized(unit: int, label: str) -> str:
    return (f"when {_NUMBER} >= {unit} then case when {_NUMBER} % {unit} = 0 then format('{{:,}} {label}', {_NUMBER} // {unit}) "
            f"else format('{{:,.1f}} {label}', {_NUMBER} / {unit}::double) end ")


_METRIC_LABEL = (
    f"metric_name || coalesce(': ' || case when {_NUMBER} is null then value when metric_type = 'size' then case "
    + _sized(GIB, "GiB") + _sized(MIB, "MiB") + _sized(1024, "KiB")
    + f"else format('{{:,}} B', {_NUMBER}) end when metric_type = 'timing' then format('{{:,}} ms', {_NUMBER}) "
    f"when metric_type = 'nsTiming' then format('{{:,}} ns', {_NUMBER}) else format('{{:,}}', {_NUMBER}) end, '')")


_ITEM = "(select *, l_orderkey * 8 + l_linenumber as k, 'a' || (l_suppkey % 4) as log_id from lineitem)"
#: What the parsers must read from the lines that each line item stands for.
PARSED = {
    "parse_applications": "select log_id, l_linenumber % 2 <> 0 as is_start, 'app_' || k as app_id, "
                          "case when l_partkey % 3 > 0 then 'n' || k end as app_name, "
                          "case l_linenumber % 4 when 2 then 0 when 3 then null else l_partkey end::bigint as time_ms "
                          f"from {_ITEM}",
    "job_events": "select log_id, case when l_linenumber % 2 = 0 then 'end' else 'start' end as kind, "
                  "l_orderkey::int as job_id, case when l_linenumber % 2 = 0 then case l_partkey % 3 when 1 then 'JobSucceeded' "
                  f"when 2 then 'JobFailed' end end as result from {_ITEM} where l_partkey % 5 > 0",
    "job_stage_map": "select log_id, l_orderkey as execution_id, unnest(list_distinct([l_partkey, l_suppkey] || "
                     "case when l_linenumber = 7 then []::bigint[] else [l_partkey + 1] end))::int as stage_id "
                     f"from {_ITEM} where l_linenumber % 3 = 1",
    "stage_events": "select log_id, case when l_linenumber % 2 = 0 then 'completed' else 'submitted' end as kind, "
                    "l_orderkey::int as stage_id, (l_partkey % 2)::int as stage_attempt_id, 's \"' || k || '\"' as stage_name, "
                    "l_partkey::int as num_tasks, case when l_partkey % 3 = 0 then 'lost' end as failure_reason "
                    f"from {_ITEM} where l_partkey % 7 > 0",
    "stage_accumulables": "select log_id, v.pos::int as pos, l_orderkey::int as stage_id, 0::int as stage_attempt_id, "
                          "case v.pos when 0 then l_partkey else l_suppkey end as accumulator_id, "
                          "(case v.pos when 0 then l_suppkey else l_partkey end)::varchar as value "
                          f"from {_ITEM}, (values (0), (2)) v(pos)",
    "sql_execution_events": "select log_id, case l_linenumber % 4 when 0 then 'start' when 1 then 'update' when 2 then 'end' "
                            "else 'accumulators' end as kind, l_orderkey as execution_id, null::bigint as root_execution_id, "
                            "'d' || k as description, null::varchar as details, l_partkey as time_ms, "
                            "null::varchar as plan_description, null::varchar as plan_json, "
                            f"case when l_partkey % 2 = 0 then '' end as error_message from {_ITEM} where l_partkey % 5 > 0",
    "driver_accum_updates": "select log_id, v.pos::int as pos, l_orderkey as execution_id, "
                            "case v.pos when 0 then l_partkey when 3 then 0 else l_suppkey end::bigint as accumulator_id, "
                            "case v.pos when 0 then l_suppkey::varchar when 3 then 'y' else l_partkey::varchar end as value "
                            f"from {_ITEM}, (values (0), (3), (5)) v(pos)",
    "scan_event_lines": "select log_id, event, count(*) as lines, count(*) as places from (select log_id, 'SparkListener' || unnest(["
                        "case when l_linenumber % 2 = 0 then 'ApplicationEnd' else 'ApplicationStart' end, "
                        "case when l_linenumber % 2 = 0 then 'JobEnd' else 'JobStart' end, "
                        "case when l_linenumber % 2 = 0 then 'StageCompleted' else 'StageSubmitted' end, "
                        "case l_linenumber % 4 when 0 then 'SQLExecutionStart' when 1 then 'SQLAdaptiveExecutionUpdate' "
                        f"when 2 then 'SQLExecutionEnd' else 'DriverAccumUpdates' end]) as event from {_ITEM}) group by all",
}


_FILES = f"(select *, {_cols(tb.FILES)} from orders)"
_CATEGORIES = {
    "exchanges": "node_name like '%Exchange%'", "sorts": "node_name = 'Sort'", "hashaggregates": "node_name like '%HashAggregate%'",
    "joins": "node_name like '%Join%'", "scans": "node_name like '%Scan%'",
    "aqe_nodes": "node_name = 'AdaptiveSparkPlan' or node_name like 'AQE%' or node_name like '%QueryStage'"}


def oracle_sql() -> dict[str, str]:
    w = with_ctes
    latest = "join latest l using (log_id, stage_id, stage_attempt_id)"
    sql = {
        "recognise_events":
            "select concat('app-', o_custkey) as log_id, case when o_orderstatus = 'O' then 'SparkListenerApplicationStart' "
            "when o_orderstatus = 'P' then 'SparkListenerJobEnd' else 'SparkListenerSQLExecutionEnd' end as event, "
            "case when o_orderstatus = 'O' then '{\"Event\":\"SparkListenerApplicationStart\",\"App ID\":\"application_' || o_custkey "
            "|| '\",\"App Name\":\"' || o_orderpriority || '\"}' when o_orderstatus = 'P' then "
            "'{\"Event\":\"SparkListenerJobEnd\",\"Job ID\":' || o_orderkey || '}' else "
            "'{\"Event\":\"org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd\",\"executionId\":' || o_orderkey || '}' end "
            "as value from orders where o_orderstatus <> 'F' or o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW')",
        "validate_logs":
            "select *, case when corrupt_lines > 0 then 'corrupt' when recognised = 0 then 'no_events' when starts > 1 then "
            "'several_applications' else 'ok' end as status from (select concat('app-', o_custkey) as log_id, "
            "count(*) filter (where o_orderstatus <> 'F' or o_orderpriority not in ('4-NOT SPECIFIED', '5-LOW')) as recognised, "
            "count(*) filter (where o_orderstatus = 'O') as starts, count(*) filter (where o_orderstatus = 'F' and "
            "o_orderpriority = '4-NOT SPECIFIED') as corrupt_lines from orders group by all)",
        "extract_fields":
            "select l_orderkey, l_linenumber, case when l_linenumber <= 4 then cast(l_quantity as bigint) when l_linenumber = 5 "
            "then 0 else null end as number from lineitem",
        "task_attempts": w(f"select {K}, task_index, task_id, success, reason, speculative, duration_ms, shuffle_read_bytes, "
                           "memory_bytes_spilled, disk_bytes_spilled, executor_id, host from attempts"),
        "task_success": w("select log_id, task_id, success, reason from attempts"),
        "application_events": w("select * from applications", APPLICATIONS),
        "latest_stage_attempt": w("select log_id, stage_id, stage_attempt_id from latest"),
        "stage_outcome": w(f"select {K}, stage_name, failure_reason, outcome from outcome"),
        "stage_execution_asof": w("select log_id, stage_id, stage_attempt_id, execution_id from asof_"),
        "accumulator_replay": w("select log_id, execution_id, accumulator_id, value, source from replay"),
        "sql_metric_values": w("select log_id, execution_id, accumulator_id, arg_max(value, seq) as value from replay group by all"),
        "accumulator_union": w(
            "select 'driver' as source, log_id, execution_id, null::bigint as stage_id, null::bigint as stage_attempt_id, pos, accumulator_id, "
            "value from driver_values union all select 'stage', log_id, null, stage_id, stage_attempt_id, pos, accumulator_id, value "
            "from stage_values"),
        "metric_lookup": w(_METRIC_VALUES),
        "suppress_duplicates": findings_sql(
            "select log_id, type, stage_id, execution_id from findings where type in "
            "('duplicate_sql_subtree', 'possible_missed_exchange_reuse')"),
        "link_recommendations": findings_sql(
            "select log_id, position, type, stage_id, 'bottleneck-' || position as related_id, 'linked' as status from numbered"),
        "hotspot_inputs": with_ctes(
            "select s.log_id, s.stage_id, s.stage_name, s.outcome = 'failed' as failed, coalesce(i.n, 0) as issues, "
            "s.completed_tasks, s.duration_avg_ms, s.duration_max_ms, s.shuffle_total_bytes, s.memory_total_bytes, "
            "s.disk_total_bytes from stages s left join (select log_id, stage_id, count(*) as n from findings group by all) i "
            "using (log_id, stage_id)", STAGE_FINDINGS),
        "subtree_self_join": w("select log_id, execution_id, ord, operators from shapes"),
        "subtree_shape": w("select log_id, execution_id, ord, subtree_size, subtree_depth from shapes"),
        "preorder_end": w("select log_id, execution_id, ord, end_ord from spans"),
        "summary_counts": findings_sql("select * from summary", SUMMARY),
        "job_state": w("select log_id, job_id, result, state, case when state = 'failed' then row_number() over "
                       "(partition by log_id, state order by failed_seq) end as failed_rank from jobs"),
        "stage_details": w(f"select {K}, stage_name, num_tasks from details"),
        "successful_logical_tasks": w(
            f"select {K}, task_index, duration_ms, shuffle_read_bytes, memory_bytes_spilled, disk_bytes_spilled, executor_id, "
            "host from firsts"),
        "task_count": w("select s.log_id, s.t + coalesce(l.n, 0) as tasks from (select log_id, sum(completed_tasks)::bigint as t "
                        "from stages group by all) s left join (select log_id, count(distinct task_id) as n from attempts where "
                        "success and (stage_id is null or task_index is null) group by all) l using (log_id)"),
        "stage_duration_stats": w(f"select {K}, {_zero('completed_tasks', 'duration_samples')}, duration_min_ms, "
                                  f"duration_max_ms, duration_avg_ms from tried left join done using ({K}) {latest}"),
        "stage_shuffle_stats": w(f"select {K}, {_zero('shuffle_samples', 'shuffle_total_bytes')}, shuffle_max_bytes "
                                 f"from tried left join done using ({K}) {latest}"),
        "stage_spill_stats": w(f"select {K}, {_zero('spill_samples', 'memory_total_bytes', 'disk_total_bytes')}, "
                               f"memory_max_bytes, disk_max_bytes from tried left join done using ({K}) {latest}"),
        "exact_median": w(f"select {K}, metric, median from stats"),
        "nearest_rank_percentile": w(f"select {K}, metric, p95, p99 from stats"),
        "sorted_samples": w(f"select {K}, metric, value, min(r) as first_rank, count(*) as n from ranked group by {K}, metric, value"),
        "failed_attempts": w("select s.log_id, s.stage_id, s.stage_attempt_id, failed_attempts, failed_ms, attempt_reasons, "
                             "all_failed_attempts, all_failed_ms, all_reasons from stages s"),
        "speculative_attempts": w(f"select {K}, {_zero('speculative_attempts', 'speculative_ms')} "
                                  f"from tried left join extra using ({K}) {latest}"),
        "duplicate_successes": w(f"select {K}, {_zero('duplicate_successes')} from tried left join extra using ({K}) {latest}"),
        "executor_summary": w(f"select {K}, worker_id, task_count, duration_ms, task_share, duration_share from workers "
                              f"{latest} where kind = 'executor'"),
        "host_summary": w(f"select {K}, worker_id, task_count, duration_ms, task_share, duration_share from workers "
                          f"{latest} where kind = 'host'"),
        "heaviest_worker": w(f"select {K}, kind, workers, worker_id from heaviest where nth = 1"),
        "sql_execution_merge": w(
            "select log_id, execution_id, root_execution_id, description, details, start_ms, end_ms, duration_ms, "
            "plan_description, latest_plan_description, error_message from executions"),
        "sql_status": w("select log_id, execution_id, case when trim(error_message) <> '' then 'failed' when end_ms is null "
                        "then 'unknown' else 'success' end as status from executions"),
        "operator_counts": w("select *, row_number() over (partition by log_id, "
                             "execution_id order by count desc, node_name) as rank from (select log_id, execution_id, node_name, count(*) as count "
                             "from nodes group by all)"),
        "operator_categories": w(
            "select log_id, execution_id, count(*) filter (where node_name like '%Exchange%') as exchanges, "
            "count(*) filter (where node_name = 'Sort') as sorts, count(*) filter (where node_name like '%HashAggregate%') "
            "as hashaggregates, count(*) filter (where node_name like '%Join%') as joins, "
            "count(*) filter (where node_name like '%Scan%') as scans, count(*) filter (where node_name = 'AdaptiveSparkPlan' "
            "or node_name like 'AQE%' or node_name like '%QueryStage') as aqe_nodes from nodes group by all"),
        "count_by_name": w("select log_id, execution_id, count(*) filter (where node_name = 'Exchange') as count from nodes group by all"),
        "duplicate_subtrees": w("select log_id, execution_id, root, count, subtree_size, subtree_depth, operators, "
                                "coalesce(interesting, '') as interesting, row_number() over (partition by log_id, execution_id "
                                "order by subtree_size desc, count desc, subtree_depth desc, root, first_ord) as rank from telling"),
        "severity_counts": findings_sql("select * from severities", SEVERITIES),
        "issue_count_by_stage": with_ctes("select log_id, stage_id, count(*) as issues from findings group by all", STAGE_FINDINGS),
        "top_bottlenecks": findings_sql(
            "select log_id, rank, type, severity, message from (select *, row_number() over (partition by log_id order by "
            "case severity when 'high' then 0 when 'medium' then 1 else 2 end, position) as rank from numbered) where rank <= 3"),
        "stage_hotspots": with_ctes(
            "select log_id, stage_id, failed, issues, rank from (select *, row_number() over (partition by log_id order by "
            "failed desc, issues desc, coalesce(duration_max_ms, 0) desc, shuffle_total_bytes desc, "
            "memory_total_bytes + disk_total_bytes desc, stage_id) as rank from (select s.log_id, s.stage_id, "
            "s.outcome = 'failed' as failed, coalesce(i.n, 0) as issues, s.duration_max_ms, s.shuffle_total_bytes, "
            "s.memory_total_bytes, s.disk_total_bytes from stages s left join (select log_id, stage_id, count(*) as n from "
            "findings group by all) i using (log_id, stage_id)) where failed or issues > 0 or duration_max_ms > 0 or "
            "shuffle_total_bytes > 0 or memory_total_bytes + disk_total_bytes > 0) where rank <= 5", STAGE_FINDINGS),
        "bottleneck_instance_id": findings_sql(
            "select log_id, type, stage_id, execution_id, 'bottleneck-' || position as instance_id from numbered"),
        "stage_first_seen": w("select log_id, stage_id, row_number() over (partition by log_id order by first_seq) as position "
                              "from latest"),
        "last_completion": w(f"select {K}, stage_name, num_tasks, failure_reason from completions"),
        "all_bottlenecks": findings_sql("select log_id, 'bottleneck-' || position as instance_id, type, severity, stage_id, "
                                        "execution_id, message from numbered"),
        "known_ids": w("select distinct * from (select log_id, 'job' as kind, job_id as id from job_events union all "
                       "select log_id, 'stage', stage_id from stage_events union all select log_id, 'stage', stage_id "
                       "from attempts where stage_id is not null)"),
        "rule_failed_job": w("select log_id, 'high' as severity, job_id as \"jobId\", coalesce(result, 'unknown') as result "
                             "from jobs where state = 'failed'"),
        "recommendations": findings_sql(
            f"select log_id, position, {RECOMMENDATION_ID} as recommendation_id, severity, type, stage_id, "
            "'bottleneck-' || position as related_id from numbered"),
        "human_bytes": f"select l_orderkey, l_linenumber, l_partkey, x, {human_bytes('x')} as text from (select *, "
                       "cast(round(l_extendedprice * 100) as bigint) * power(10, l_linenumber - 2)::bigint * "
                       "(l_linenumber % 3) as x from lineitem)",
        "human_millis": f"select l_orderkey, l_linenumber, l_partkey, x, {human_millis('x')} as text from (select *, "
                        "cast(round(l_extendedprice) as bigint) * (l_linenumber % 5) * cast(l_quantity as bigint) as x from lineitem)",
        "normalize_plan_text": w("select log_id, execution_id, ord, normal_text from normal"),
        "subtree_fingerprint": w("select log_id, execution_id, ord, fingerprint from shapes"),
        "plan_nodes_flatten": w("select log_id, execution_id, ord, depth, node_name, simple_string from nodes"),
        "plan_graph_edges": w("select n.log_id, n.execution_id, 'n' || (select max(p.ord) from nodes p where "
                              "p.execution_id = n.execution_id and p.ord < n.ord and p.depth = n.depth - 1) as parent, "
                              "'n' || n.ord as child from nodes n where n.ord > 0"),
        # Six of a node's seven metrics have a name; five are shown.
        "plan_graph_nodes": w(
            "select n.log_id, n.execution_id, 'n' || n.ord as node, n.node_name as name, "
            "case when n.simple_string <> n.node_name then n.simple_string end as detail, coalesce(l.labels, '') as labels "
            "from nodes n left join (select log_id, execution_id, ord, string_agg(label, ',' order by pos) || ',+2 more metrics' "
            f"as labels from (select log_id, execution_id, ord, pos, {_METRIC_LABEL} as label from ({_METRIC_VALUES}) "
            "where metric_name is not null qualify row_number() over (partition by log_id, execution_id, ord order by pos) <= 5) "
            "group by log_id, execution_id, ord) l using (log_id, execution_id, ord)"),
        "evidence_rows": with_ctes(_evidence_body(), FIGURES),
        "recommendation_text": findings_sql(_text_body(), SPOKEN),
        "recommendation_report": findings_sql(_recommendation_report(), SUMMARY, SEVERITIES, APPLICATIONS, HOTSPOTS, SPOKEN, FIGURES),
        "report_rows": findings_sql(_report_rows(), SUMMARY, APPLICATIONS, SPOKEN, FIGURES),
        "sql_execution_report": w(
            "select x.log_id, x.execution_id, coalesce(x.description, 'unknown') as description, x.root_execution_id, x.start_ms, x.end_ms, "
            "x.duration_ms, case when trim(x.error_message) <> '' then 'failed' when x.end_ms is null then 'unknown' else 'success' end "
            "as status, x.error_message, x.details, x.plan_description, x.latest_plan_description, c.* exclude (log_id, execution_id), "
            "coalesce(d.repeated_subtrees, '') as repeated_subtrees from executions x join (select log_id, execution_id, "
            + ", ".join(f"coalesce(sum(n) filter (where {match}), 0)::bigint as {name}" for name, match in _CATEGORIES.items())
            + ", string_agg(node_name || '=' || n, ',' order by n desc, node_name) as operators from (select log_id, execution_id, node_name, "
            "count(*) as n from nodes group by all) group by all) c using (log_id, execution_id) left join (select log_id, execution_id, "
            "string_agg(concat_ws('/', root, count, subtree_size, subtree_depth, replace(operators, ',', '+'), "
            "replace(coalesce(interesting, ''), ',', '+')), ',' order by "
            "subtree_size desc, count desc, subtree_depth desc, root, first_ord) as repeated_subtrees from telling group by all) d "
            "using (log_id, execution_id)"),
        "sanitize_events": _sanitize_sql(),
        "sanitize_audit": _audit_sql(),
        "scan_compressed": "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) - 1 as at, "
                           "'{\"k\":' || (l_linenumber * 16777216 + cast(round(l_extendedprice * 100) as bigint)) || '}' as value from lineitem",
        "event_file_filter": f"select path, o_orderkey % 9 > 2 as holds_events from {_FILES}",
        "rolling_order":
            "select path, row_number() over (partition by o_custkey order by part, path) as place from (select *, max(again) over (partition "
            "by o_custkey) as repeated from (select *, row_number() over (partition by o_custkey, part order by path) > 1 as again from "
            f"(select *, case when o_orderkey % 9 = 3 then 100 else o_orderkey % 13 end as part from {_FILES} where o_orderkey % 9 > 2))) "
            "where repeated",
        "log_layout":
            "select *, case when application_folders > 0 and direct_files > 0 then 'several_applications' else 'ok' end as status from "
            "(select '/fleet/app-' || o_custkey as log_id, count(*) filter (where o_orderstatus = 'O') as direct_files, "
            "max((o_orderstatus <> 'O')::bigint) as application_folders from orders where o_orderkey % 9 > 2 group by o_custkey)",
        "register_rule": w(
            "select log_id, 'long_tail' as type, 'low' as severity, stage_id, 'Stage ' || stage_id || ' has a long tail.' as message, "
            "'{\"median\":' || median_duration_ms || ',\"p99\":' || p99_duration_ms || '}' as evidence from stages "
            "where p99_duration_ms > 2 * median_duration_ms"),
        "result_tables": w("select log_id, 'job' as kind, job_id as id, result as value from jobs union all "
                           "select log_id, 'stage', stage_id, failure_reason from completions"),
        "audit_application_starts":
            "select concat('app-', o_custkey) as log_id, 'application starts: ' || count(*) filter (where o_orderstatus = 'O') "
            "as violation from orders group by o_custkey having count(*) filter (where o_orderstatus = 'O') <> 1",
        "stream_stage_totals": w(
            f"select {K}, count(*) as attempts, count(*) filter (where success) as successes, count(*) filter (where not success) "
            "as failures, coalesce(sum(duration_ms) filter (where success), 0)::bigint as success_ms, "
            "coalesce(sum(duration_ms) filter (where not success), 0)::bigint as failed_ms, "
            f"count(*) filter (where success and speculative) as speculative from attempts where stage_id is not null group by {K}"),
    }
    totals = sql["stream_stage_totals"]
    sql["late_attempt_rule"] = (f"select * from ({totals}) qualify stage_attempt_id = max(stage_attempt_id) "
                                "over (partition by log_id, stage_id)")
    sql["stream_event_lines"] = sql["task_attempts"]
    sql |= PARSED
    for name in STAGE_RULES:
        sql[f"rule_{name}"] = stage_rule_sql(name)
    for name, (body, *_rest) in PLAN_RULES.items():
        sql[f"rule_{name}"] = w(body)
    return sql


_EVIDENCE_TEXTS = ("executorId", "host", "stageName", "failureReason", "description", "topDuplicateRoot", "confidence",
                   "confidenceReason", "validationRequired", "result")
_TOP_KEYS = ("topDuplicateRoot", "topDuplicateCount", "topDuplicateSubtreeSize", "topDuplicateMaxDepth",
             "topDuplicateInterestingOperators")
PLAN_EVIDENCE = {
    "sql_many_exchanges": ("sqlExecutionId", "exchangeCount", "minExchangeOperators", "description"),
    "duplicate_sql_subtree": ("sqlExecutionId", "description", "duplicateGroups", *_TOP_KEYS),
    "possible_missed_exchange_reuse": ("sqlExecutionId", "description", "duplicateExchangeGroups", *_TOP_KEYS, "confidence",
                                       "confidenceReason", "validationRequired"),
}
_FINDING_KEY = "log_id, type, stage_id, execution_id, job_id"
_SAME_FINDING = ("n.log_id = f.log_id and n.type = f.type and n.stage_id = f.stage_id and n.execution_id is not distinct from "
                 "f.execution_id and n.job_id is not distinct from f.job_id")


def _json_list(v: str) -> str:
    return f"case when {v} = '' then '[]' else '[\"' || replace({v}, ',', '\",\"') || '\"]' end"


def _figure(head: str, key: str, v: str, source: str) -> str:
    value = display = f"({v})::varchar"
    json = f"regexp_replace(({v})::varchar, '\\.0$', '')"
    if key.endswith("Reasons") or key.endswith("InterestingOperators"):
        value = json = _json_list(v)
        display = f"replace({v}, ',', ', ')"
    elif key in _EVIDENCE_TEXTS:
        json = f"'\"' || {v} || '\"'"
    elif "Bytes" in key or "Millis" in key:
        human = human_bytes("x") if "Bytes" in key else human_millis("x")
        display = f"(select x || ' (' || {human} || ')' from (select ({v})::bigint as x))"
    return f"select {head}, '{key}' as key, {value} as value, {display} as display, {json} as json from {source}"


def _evidence_figures() -> str:
    """Every entry of every finding: its text, its display, and its JSON."""
    parts = []
    for name, (where, _severity, evidence, *_rest) in STAGE_RULES.items():
        head = f"log_id, '{name}' as type, stage_id, null::bigint as execution_id, null::bigint as job_id"
        parts += [_figure(head, key, v, f"stages where {where}") for key, v in evidence.items()]
    for name, keys in PLAN_EVIDENCE.items():
        head = f"log_id, '{name}' as type, -1 as stage_id, \"sqlExecutionId\" as execution_id, null::bigint as job_id"
        parts += [_figure(head, key, key if key == "description" else f'"{key}"', f"({PLAN_RULES[name][0]})") for key in keys]
    head = "log_id, 'failed_job' as type, -1 as stage_id, null::bigint as execution_id, job_id"
    parts += [_figure(head, key, v, "jobs where state = 'failed'")
              for key, v in (("jobId", "job_id"), ("result", "coalesce(result, 'unknown')"))]
    return " union all ".join(parts)


FIGURES = ("figures", _evidence_figures())


def _evidence_body() -> str:
    return "select log_id, stage_id, execution_id, type, key, value, display from figures"


def _sentences() -> dict[str, str]:
    """What is said of each finding; plan findings and failed jobs name no figures."""
    stage = "'Stage ' || stage_id"
    some = lambda n, noun: f"{n} || ' {noun}' || case when {n} = 1 then '' else 's' end"

    def crossed(value: str, limit: int, what: str) -> str:
        return (f"case when {value} >= {limit} then ' {what} reached the medium threshold of ' || {human_bytes(str(limit))} || '.' "
                "else '' end")

    spill = f"{stage} || ' has tasks that spilled far more {{}} than the median.'"
    return {
        "task_duration_skew": f"{stage} || ' has tasks that ran far longer than the average.'",
        "shuffle_partition_skew":
            f"{stage} || ' has a task that read ' || {human_bytes('shuffle_max_bytes')} || ' of shuffle data against a median of ' || "
            f"{human_bytes('median_shuffle_read_bytes')} || ', ' || round(shuffle_max_bytes::double / median_shuffle_read_bytes, 2) "
            "|| ' times as much.'",
        "oversized_shuffle_partitions":
            f"{stage} || ' has ' || {some('shuffle_samples', 'shuffle-reading task')} || ' with a p95 of ' || "
            f"{human_bytes('p95_shuffle_read_bytes')} || ' and a maximum of ' || {human_bytes('shuffle_max_bytes')} || '.' || "
            + crossed("p95_shuffle_read_bytes", 256 * MIB, "The p95"),
        "low_shuffle_parallelism":
            f"{stage} || ' read ' || {human_bytes('shuffle_total_bytes')} || ' of shuffle data in only ' || "
            f"{some('shuffle_samples', 'task')} || ', about ' || {human_bytes(SHUFFLE_AVG)} || ' each.'",
        "spill_pressure":
            f"{stage} || ' spilled ' || {human_bytes('disk_total_bytes')} || ' to disk and ' || {human_bytes('memory_total_bytes')} "
            f"|| ' from memory over ' || {some('completed_tasks', 'completed task')} || '.' || "
            + crossed("disk_total_bytes", 256 * MIB, "Disk spill"),
        "memory_spill_skew": spill.format("memory"),
        "disk_spill_skew": spill.format("to disk"),
        "too_many_tiny_tasks": f"{stage} || ' ran many very short tasks.'",
        "retry_waste":
            f"{stage} || ' lost ' || {human_millis('all_failed_ms')} || ' in ' || {some('all_failed_attempts', 'failed task attempt')} || '.'",
        "speculation_heavy": f"{stage} || ' ran many speculative task attempts.'",
        "executor_imbalance": f"{stage} || ' ran mostly on one executor.'",
        "host_imbalance": f"{stage} || ' ran mostly on one host.'",
        "failed_stage":
            f"{stage} || ' failed.' || case when trim(failure_reason) <> '' then ' Failure reason: ' || failure_reason || '.' else '' end "
            f"|| case when failed_attempts > 0 then ' It had ' || {some('failed_attempts', 'failed task attempt')} || "
            f"case when failed_ms > 0 then ' taking ' || {human_millis('failed_ms')} else '' end || '.' else '' end || "
            "case when attempt_reasons <> '' then ' Task failure reasons: ' || replace(attempt_reasons, ',', ', ') || '.' else '' end",
        "sql_many_exchanges": "'SQL execution ' || execution_id || ' has many exchanges in its physical plan.'",
        "duplicate_sql_subtree": "'SQL execution ' || execution_id || ' repeats parts of its physical plan.'",
        "possible_missed_exchange_reuse": "'SQL execution ' || execution_id || ' repeats an exchange in its physical plan.'",
        "failed_job": "'A job failed before the application ended.'",
    }


def _text_parts() -> str:
    text = {t: a for t, _, _, a in advise.ADVICE}
    parts = []
    for name, sentence in _sentences().items():
        said = f"{sentence} || ' {text[name]}' as description"
        if name in STAGE_RULES:
            parts.append(f"select log_id, '{name}' as type, stage_id, null::bigint as execution_id, null::bigint as job_id, {said} "
                         f"from stages where {STAGE_RULES[name][0]}")
        else:
            parts.append(f"select {_FINDING_KEY}, {said} from findings where type = '{name}'")
    return " union all ".join(parts)


SPOKEN = ("spoken", _text_parts())
TITLE = "case n.type " + " ".join(f"when '{t}' then '{title}'" for t, _, title, _ in advise.ADVICE) + " end"


def _text_body() -> str:
    return f"select n.log_id, n.position, n.type, {TITLE} as title, f.description from numbered n join spoken f on {_SAME_FINDING}"


def _entries(section: str, position: str, columns: dict[str, str], source: str) -> str:
    listed = ", ".join(f'({v})::varchar as "{k}"' for k, v in columns.items())
    return (f"select log_id, '{section}' as section, position, entry, value from (unpivot (select log_id, ({position})::bigint as position, "
            f"{listed} from {source}) on columns(* exclude (log_id, position)) into name entry value value)")


_UNKNOWN = "coalesce({}, 'unknown')"
SUMMARY_COLUMNS = ("jobs", "jobs_completed", "jobs_failed", "stages", "stages_completed", "stages_failed", "tasks", "issues")


def _recommendation_report() -> str:
    hot = {"stageId": "stage_id", "name": "coalesce(stage_name, 'unknown')", "issues": "issues", "failed": "case when failed then 'true' end",
           "completedTasks": "completed_tasks", "avgTaskDurationMillis": "coalesce(duration_avg_ms::varchar, 'unknown')",
           "maxTaskDurationMillis": "coalesce(duration_max_ms::varchar, 'unknown')", "shuffleReadBytes": "shuffle_total_bytes",
           "memoryBytesSpilled": "memory_total_bytes", "diskBytesSpilled": "disk_total_bytes"}
    scope = ("case when n.stage_id >= 0 then 'stage ' || n.stage_id when n.execution_id is not null then 'SQL execution ' || "
             "n.execution_id else 'application' end")
    known = ("(select s.*, a.app_name, a.app_id, a.duration_ms, v.summary as severities from summary s left join applications a "
             "using (log_id) left join severities v using (log_id))")
    advice = (f"(select n.*, f.description, {TITLE} as title, {scope} as scope from numbered n join spoken f on {_SAME_FINDING})")
    return " union all ".join([
        _entries("application", "0", {"name": "coalesce(app_name, 'unknown')", "id": "coalesce(app_id, 'unknown')",
                                      "durationMillis": "coalesce(duration_ms::varchar, 'unknown')"}, known),
        _entries("summary", "0", {c: c for c in SUMMARY_COLUMNS} | {"severities": "coalesce(severities, 'none')"}, known),
        _entries("hotspots", "rank", hot, "hotspots"),
        _entries("recommendations", "position", {"title": "title", "severity": "severity", "scope": "scope", "relatedBottleneck": "type",
                                                 "description": "description"}, advice),
        "select n.log_id, 'evidence' as section, n.position, f.key as entry, f.display as value from numbered n join figures f on "
        + _SAME_FINDING])


def _report_rows() -> str:
    stats = {f"{s}Task{label}": f"{s}_{m}" for m, label in (
        ("duration_ms", "DurationMillis"), ("shuffle_read_bytes", "ShuffleReadBytes"), ("memory_bytes_spilled", "MemoryBytesSpilled"),
        ("disk_bytes_spilled", "DiskBytesSpilled")) for s in ("median", "p95", "p99")}
    stage = {"id": "stage_id", "name": "stage_name", "taskCount": "num_tasks", "completedTasks": "completed_tasks",
             "minTaskDurationMillis": "duration_min_ms", "maxTaskDurationMillis": "duration_max_ms", "avgTaskDurationMillis": "duration_avg_ms",
             "failedTaskAttempts": "all_failed_attempts", "failedTaskAttemptDurationMillis": "all_failed_ms",
             "failedTaskAttemptReasons": _json_list("all_reasons"), "speculativeTaskAttempts": "speculative_attempts",
             "speculativeTaskAttemptDurationMillis": "speculative_ms", "duplicateSuccessfulTaskAttempts": "duplicate_successes",
             "shuffleReadBytes": "shuffle_total_bytes", "maxTaskShuffleReadBytes": "shuffle_max_bytes",
             "memoryBytesSpilled": "memory_total_bytes", "diskBytesSpilled": "disk_total_bytes",
             "maxTaskMemoryBytesSpilled": "memory_max_bytes", "maxTaskDiskBytesSpilled": "disk_max_bytes", **stats}
    broken = {"id": "stage_id", "name": "done_name", "failureReason": "failure_reason", "failedTaskAttempts": "failed_attempts",
              "failedTaskAttemptDurationMillis": "failed_ms", "failedTaskAttemptReasons": _json_list("attempt_reasons")}
    execution = {"id": "execution_id", "rootExecutionId": "root_execution_id", "description": "description", "details": "details",
                 "startTimeMillis": "start_ms", "endTimeMillis": "end_ms", "durationMillis": "duration_ms",
                 "physicalPlanDescription": "plan_description", "latestPhysicalPlanDescription": "latest_plan_description",
                 "errorMessage": "error_message", "operatorSummaries": "coalesce(operators, '[]')"}
    operators = ("(select x.*, o.operators from executions x left join (select log_id, execution_id, '[' || string_agg('{\"name\":\"' "
                 "|| node_name || '\",\"count\":' || n || '}', ',' order by n desc, node_name) || ']' as operators from (select log_id, "
                 "execution_id, node_name, count(*) as n from nodes group by all) group by all) o using (log_id, execution_id))")
    evidence = (f"(select {_FINDING_KEY}, '{{' || string_agg('\"' || key || '\":' || json, ',' order by key) || '}}' as evidence "
                f"from figures group by {_FINDING_KEY})")
    found = f"(select n.*, f.evidence from numbered n join {evidence} f on {_SAME_FINDING})"
    advice = f"(select n.*, f.description, {TITLE} as title from numbered n join spoken f on {_SAME_FINDING})"
    producer = f"'{{\"name\":\"{report.PRODUCER}\",\"version\":\"{report.__version__}\"}}'"
    parts = [
        _entries("header", "0", {"schemaVersion": f"'{report.SCHEMA_VERSION}'", "producer": producer}, "summary"),
        _entries("application", "0", {"id": "app_id", "name": "app_name", "startTimeMillis": "start_ms", "endTimeMillis": "end_ms",
                                      "durationMillis": "duration_ms"}, "applications"),
        _entries("summary", "0", {"jobs": "jobs", "jobsCompleted": "jobs_completed", "jobsFailed": "jobs_failed", "stages": "stages",
                                  "stagesCompleted": "stages_completed", "stagesFailed": "stages_failed", "tasks": "tasks",
                                  "issuesDetected": "issues"}, "summary"),
        _entries("stages", "stage_id", stage, "stages"),
        _entries("sqlExecutions", "execution_id", execution, operators),
        _entries("failedJobs", "job_id", {"id": "job_id", "result": "result"}, "(select * from jobs where state = 'failed')"),
        _entries("failedStages", "stage_id", broken, "(select * from stages where outcome = 'failed')"),
        _entries("bottlenecks", "position", {"instanceId": "'bottleneck-' || position", "type": "type", "severity": "severity",
                                             "message": "message", "stageId": "stage_id", "evidence": "evidence"}, found),
        _entries("recommendations", "position", {
            "id": RECOMMENDATION_ID, "severity": "severity", "title": "title", "description": "description",
            "relatedBottleneckType": "type", "stageId": "stage_id", "relatedBottleneckId": "'bottleneck-' || position"}, advice)]
    parts += [f"select log_id, '{section}', stage_id, 'row', stage_id || '|' || worker_id || '|' || task_count || '|' || duration_ms || '|' "
              "|| format('{:.4f}', task_share) || '|' || format('{:.4f}', duration_share) from workers join latest "
              f"using (log_id, stage_id, stage_attempt_id) where kind = '{kind}'"
              for kind, section in (("executor", "executorSummaries"), ("host", "hostSummaries"))]
    parts += [f"select log_id, '{section}', stage_id, 'row', stage_id || '|' || value || '|' || min(r) || '|' || count(*) from ranked "
              f"join latest using (log_id, stage_id, stage_attempt_id) where metric = '{metric}' group by log_id, stage_id, value"
              for metric, section in report.SAMPLE_SECTIONS.items()]
    return " union all ".join(parts)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PRIVATE = (f"(?:(?:0|10|24[0-9]|25[0-5])\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}|(?:169\\.254|192\\.168|198\\.1[89]|"
            f"172\\.(?:1[6-9]|2[0-9]|3[01]))\\.{_OCTET}\\.{_OCTET}|(?:192\\.0\\.2|198\\.51\\.100|203\\.0\\.113)\\.{_OCTET}"
            f"|192\\.0\\.0\\.(?:[0-8]|1[1-9]|[2-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5]))")
_WORD = "\\p{L}\\p{M}\\p{Nd}\\p{Pc}"


def _masked() -> str:
    masked = r"""regexp_replace(value, '/(?:Users|home)/[^/"'',;:}\s]+', '/tmp/scrubbed-user', 'g')"""
    masked = f"replace({masked}, '/opt/homebrew/Cellar', '/opt/scrubbed-packages')"
    masked = rf"regexp_replace({masked}, 'local-\d+', 'local-scrubbed', 'g')"
    masked = rf"""regexp_replace({masked}, '("(?:User|user\.name)"\s*:\s*)"[^"]*"', '\1"scrubbed-user"', 'g')"""
    # Neighbouring addresses share a separator, so the pass is made twice.
    for _ in range(2):
        masked = (f"regexp_replace({masked}, '(^|[^{_WORD}.-]){_PRIVATE}($|[^{_WORD}.-])', "
                  r"'\1127.0.0.1\2', 'g')")
    return f"regexp_replace({masked}, ' fd00::[0-9]+ ', ' ::1 ', 'g')"


_SCRUB = f"(select {_cols(tb.SCRUB_LINES)} from documents)"


def _sanitize_sql() -> str:
    return f"select doc_id, {_masked()} as value from {_SCRUB}"


def _audit_sql() -> str:
    hit = f"(?:^|[^{_WORD}.-])({_PRIVATE})(?:$|[^{_WORD}.-])"
    spaced = f"regexp_replace(value, '([^{_WORD}.-])', '\\1\\1', 'g')"
    raw = "(select * from documents where doc_id % 4 > 1)"
    return (f"select doc_id, 'private IP address: ' || a as violation from (select doc_id, "
            f"unnest(regexp_extract_all({spaced}, '{hit}', 1)) as a from {_SCRUB} where doc_id % 4 > 1) union all "
            f"select doc_id, 'private IP address: fd00::' || doc_id % 10000 from {raw} union all "
            "select doc_id, unnest(['macOS user path', 'Linux user path', 'Cellar path', 'not valid JSON', "
            f"'unsanitised user field']) from {raw} union all "
            "select doc_id, unnest(['forbidden value: project-x', 'unsanitised user field']) from documents where doc_id % 4 = 1")
