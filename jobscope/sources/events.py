"""From event lines to typed tables: one narrow projection per kind of event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.coerce import lenient_bool, lenient_int, lenient_long, lenient_longs

# The recognised listener events.
CORE_EVENTS = (
    "SparkListenerApplicationStart",
    "SparkListenerApplicationEnd",
    "SparkListenerJobStart",
    "SparkListenerJobEnd",
    "SparkListenerStageSubmitted",
    "SparkListenerStageCompleted",
    "SparkListenerTaskEnd",
)
SQL_EVENTS = (
    "SparkListenerSQLExecutionStart",
    "SparkListenerSQLAdaptiveExecutionUpdate",
    "SparkListenerSQLExecutionEnd",
    "SparkListenerDriverAccumUpdates",
)
(APP_START, APP_END, JOB_START, JOB_END, STAGE_SUBMITTED, STAGE_COMPLETED, TASK_END) = CORE_EVENTS
(SQL_START, SQL_UPDATE, SQL_END, DRIVER_ACCUM) = SQL_EVENTS

EXECUTION_PROPERTY = "spark.sql.execution.id"
_STAGE_INFO = ("`Stage Info` struct<`Stage ID`:string,`Stage Attempt ID`:string,`Stage Name`:string,"
               "`Number of Tasks`:string,`Failure Reason`:string>")


RECOGNISED_TAIL = r"([^.]*)$"
# One pattern, so that a line's event is looked at once: SQL events also match behind any package prefix.
RECOGNISED = r"^(?:(?:.*\.)?(" + "|".join(SQL_EVENTS) + ")|(" + "|".join(CORE_EVENTS) + "))$"


def event_name(value: Column) -> Column:
    """The event of a line without its package prefix, or NULL if the line has none."""
    return F.regexp_extract(F.get_json_object(value, "$.Event"), RECOGNISED_TAIL, 1)


def is_recognised(value: Column) -> Column:
    return F.coalesce(F.get_json_object(value, "$.Event").rlike(RECOGNISED), F.lit(False))


def recognise_events(lines: DataFrame) -> DataFrame:
    """Only lines of the recognised events, with their name; other lines are never parsed further."""
    return recognise_lines(lines).select("log_id", "seq", "event", "value")


def recognise_lines(lines: DataFrame) -> DataFrame:
    return lines.where(is_recognised(F.col("value"))).withColumn("event", event_name(F.col("value")))


def route_lines(lines: DataFrame) -> DataFrame:
    """``log_id, seq, event, value, starts_application, corrupt``: every line looked at once, for its event and for
    whether it is JSON; only lines of recognised events keep their text.

    A key may be repeated, and the last one counts.  Lines that are JSON but no object are looked at again, and are not
    corrupt.
    """
    line = F.from_json("value", "Event string, _corrupt string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = F.col("line.Event")
    known = F.coalesce(raw.rlike(RECOGNISED), F.lit(False))
    return lines.withColumn("line", line).select(
        "log_id", "seq", F.when(known, F.regexp_extract(raw, RECOGNISED_TAIL, 1)).alias("event"),
        F.when(known, F.col("value")).alias("value"), F.coalesce(raw == APP_START, F.lit(False)).alias("starts_application"),
        (F.col("line._corrupt").isNotNull() & F.try_parse_json("value").isNull()).alias("corrupt"))


def validate_logs(lines: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """One row per log: counts and whether the log is usable.  ``layout`` (``log_layout``) adds how its files lie."""
    return validate_routed(route_lines(lines), layout)


def validate_routed(routed: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """The same for lines that :func:`route_lines` has looked at."""
    counted = (
        routed.groupBy("log_id").agg(
            F.count("event").alias("recognised"), F.count_if("starts_application").alias("starts"),
            F.count_if("corrupt").alias("corrupt_lines"))
        .withColumn("status",
                    F.when(F.col("corrupt_lines") > 0, "corrupt")
                    .when(F.col("recognised") == 0, "no_events")
                    .when(F.col("starts") > 1, "several_applications").otherwise("ok"))
    )
    if layout is None:
        return counted
    # what lies wrong is not read, so nothing else is said of it
    return counted.join(layout.select("log_id", F.col("status").alias("_layout")), "log_id", "left").select(
        *[c for c in counted.columns if c != "status"],
        F.when(F.col("_layout") != "ok", F.col("_layout")).otherwise(F.col("status")).alias("status"))


def keep_valid(df: DataFrame, validation: DataFrame) -> DataFrame:
    """Drop the rows of unusable logs; the other logs of the fleet carry on."""
    return df.join(validation.where(F.col("status") != "ok"), "log_id", "left_anti")


def _parsed(events: DataFrame, names: tuple[str, ...], schema: str) -> DataFrame:
    return (events.where(F.col("event").isin(*names))
            .withColumn("e", F.from_json("value", schema)))


def application_events(events: DataFrame) -> DataFrame:
    rows = _parsed(events, (APP_START, APP_END), "`App ID` string, `App Name` string, Timestamp string")
    return rows.select(
        "log_id", "seq", (F.col("event") == APP_START).alias("is_start"),
        F.col("e.App ID").alias("app_id"), F.col("e.App Name").alias("app_name"),
        lenient_long(F.col("e.Timestamp")).alias("time_ms"))


def job_events(events: DataFrame) -> DataFrame:
    rows = _parsed(events, (JOB_START, JOB_END), "`Job ID` string, `Job Result` struct<Result:string>")
    return rows.select(
        "log_id", "seq", F.when(F.col("event") == JOB_START, "start").otherwise("end").alias("kind"),
        lenient_int(F.col("e.Job ID")).alias("job_id"),
        F.col("e.Job Result.Result").alias("result")).where(F.col("job_id").isNotNull())


def job_stage_map(events: DataFrame) -> DataFrame:
    """Stages named by each job start that carries a SQL execution id."""
    schema = (f"`Stage IDs` array<string>, `Stage Infos` array<struct<`Stage ID`:string>>, "
              f"Properties struct<`{EXECUTION_PROPERTY}`:string>")
    rows = _parsed(events, (JOB_START,), schema)
    listed = F.coalesce(F.col("e.Stage IDs"), F.array().cast("array<string>"))
    described = F.coalesce(F.col("e.Stage Infos.Stage ID"), F.array().cast("array<string>"))
    return (
        rows.select("log_id", "seq",
                    lenient_long(F.col(f"e.Properties.`{EXECUTION_PROPERTY}`")).alias("execution_id"),
                    F.explode(F.array_union(listed, described)).alias("stage"))
        .select("log_id", "seq", "execution_id", lenient_int(F.col("stage")).alias("stage_id"))
        .where(F.col("execution_id").isNotNull() & F.col("stage_id").isNotNull())
    )


def stage_events(events: DataFrame) -> DataFrame:
    rows = _parsed(events, (STAGE_SUBMITTED, STAGE_COMPLETED),
                   f"`Stage ID` string, `Stage Attempt ID` string, {_STAGE_INFO}")
    info = F.col("e.Stage Info")
    return rows.select(
        "log_id", "seq",
        F.when(F.col("event") == STAGE_COMPLETED, "completed").otherwise("submitted").alias("kind"),
        lenient_int(F.coalesce(F.col("e.Stage ID"), info["Stage ID"])).alias("stage_id"),
        F.coalesce(lenient_int(F.coalesce(F.col("e.Stage Attempt ID"), info["Stage Attempt ID"])), F.lit(0))
        .alias("stage_attempt_id"),
        info["Stage Name"].alias("stage_name"),
        lenient_int(info["Number of Tasks"]).alias("num_tasks"),
        info["Failure Reason"].alias("failure_reason"),
    ).where(F.col("stage_id").isNotNull())


def stage_accumulables(events: DataFrame) -> DataFrame:
    """SQL accumulator values reported by stage completions."""
    schema = ("`Stage ID` string, `Stage Attempt ID` string, "
              "`Stage Info` struct<`Stage ID`:string,`Stage Attempt ID`:string,"
              "Accumulables:array<struct<ID:string,Value:string,Metadata:string>>>")
    rows = _parsed(events, (STAGE_COMPLETED,), schema)
    info = F.col("e.Stage Info")
    return (
        rows.select(
            "log_id", "seq",
            lenient_int(F.coalesce(F.col("e.Stage ID"), info["Stage ID"])).alias("stage_id"),
            F.coalesce(lenient_int(F.coalesce(F.col("e.Stage Attempt ID"), info["Stage Attempt ID"])), F.lit(0))
            .alias("stage_attempt_id"),
            F.posexplode(info["Accumulables"]).alias("pos", "a"))
        .where((F.col("a.Metadata") == "sql") & F.col("a.ID").isNotNull() & F.col("a.Value").isNotNull()
               & F.col("stage_id").isNotNull())
        .select("log_id", "seq", "pos", "stage_id", "stage_attempt_id",
                lenient_long(F.col("a.ID")).alias("accumulator_id"), F.col("a.Value").alias("value"))
    )


def task_success(has_info_flag: Column, flag: Column, reason: Column) -> Column:
    """A present ``Successful`` flag that is not true fails the task; otherwise the end reason decides."""
    return ~(has_info_flag & ~lenient_bool(flag)) & F.coalesce(reason == "Success", F.lit(True))


def spill_bytes(wanted: Column, other: Column) -> Column:
    return F.when(wanted.isNotNull() | other.isNotNull(), F.coalesce(wanted, F.lit(0)))


def task_attempts(events: DataFrame) -> DataFrame:
    """One row per task end.

    Shuffle bytes are NULL only without shuffle-read metrics; zero bytes still
    make a shuffle-reading task.
    """
    schema = (
        "`Stage ID` string, `Stage Attempt ID` string, "
        "`Stage Info` struct<`Stage ID`:string,`Stage Attempt ID`:string>, "
        "`Task End Reason` struct<Reason:string>, "
        "`Task Info` struct<`Task ID`:string,`Index`:string,`Launch Time`:string,`Finish Time`:string,"
        "`Executor ID`:string,`Host`:string,`Speculative`:string,`Successful`:string>, "
        "`Task Metrics` struct<`Memory Bytes Spilled`:string,`Disk Bytes Spilled`:string,"
        "`Shuffle Read Metrics`:struct<`Local Bytes Read`:string,`Remote Bytes Read`:string>>")
    rows = _parsed(events, (TASK_END,), schema)
    info, metrics = F.col("e.Task Info"), F.col("e.Task Metrics")
    shuffle = metrics["Shuffle Read Metrics"]
    # A JSON null under the key still counts as present.
    flagged = info["Successful"].isNotNull() | (
        F.col("value").contains('"Successful"') & F.col("value").rlike(r'"Successful"\s*:\s*null'))
    texts = {
        "stage_id": F.coalesce(F.col("e.Stage ID"), F.col("e.Stage Info.Stage ID")),
        "attempt": F.coalesce(F.col("e.Stage Attempt ID"), F.col("e.Stage Info.Stage Attempt ID")),
        "index": info["Index"], "task_id": info["Task ID"], "launch": info["Launch Time"], "finish": info["Finish Time"],
        "local": shuffle["Local Bytes Read"], "remote": shuffle["Remote Bytes Read"],
        "memory": metrics["Memory Bytes Spilled"], "disk": metrics["Disk Bytes Spilled"]}
    read = rows.select(
        "log_id", "seq", lenient_longs(list(texts.values())).alias("n"), shuffle.isNotNull().alias("shuffled"),
        task_success(flagged, info["Successful"], F.col("e.Task End Reason.Reason")).alias("success"),
        F.col("e.Task End Reason.Reason").alias("reason"), lenient_bool(info["Speculative"]).alias("speculative"),
        info["Executor ID"].alias("executor_id"), info["Host"].alias("host"))
    number = {name: F.get("n", F.lit(i)) for i, name in enumerate(texts)}

    def as_int(value: Column) -> Column:
        return F.when(value.isNotNull(), F.coalesce(value.try_cast("int"), F.lit(0)))

    return read.select(
        "log_id", "seq", as_int(number["stage_id"]).alias("stage_id"),
        F.coalesce(as_int(number["attempt"]), F.lit(0)).alias("stage_attempt_id"),
        F.coalesce(number["index"], number["task_id"]).alias("task_index"), number["task_id"].alias("task_id"),
        "success", "reason", "speculative", (number["finish"] - number["launch"]).alias("duration_ms"),
        F.when(F.col("shuffled"), F.coalesce(number["local"], F.lit(0)) + F.coalesce(number["remote"], F.lit(0)))
        .alias("shuffle_read_bytes"),
        spill_bytes(number["memory"], number["disk"]).alias("memory_bytes_spilled"),
        spill_bytes(number["disk"], number["memory"]).alias("disk_bytes_spilled"),
        "executor_id", "host")


def sql_execution_events(events: DataFrame) -> DataFrame:
    schema = ("executionId string, rootExecutionId string, description string, details string, time string, "
              "physicalPlanDescription string, sparkPlanInfo string, errorMessage string")
    rows = _parsed(events, SQL_EVENTS, schema)
    return rows.select(
        "log_id", "seq",
        F.when(F.col("event") == SQL_START, "start").when(F.col("event") == SQL_UPDATE, "update")
        .when(F.col("event") == SQL_END, "end").otherwise("accumulators").alias("kind"),
        lenient_long(F.col("e.executionId")).alias("execution_id"),
        lenient_long(F.col("e.rootExecutionId")).alias("root_execution_id"),
        F.col("e.description").alias("description"), F.col("e.details").alias("details"),
        lenient_long(F.col("e.time")).alias("time_ms"),
        F.col("e.physicalPlanDescription").alias("plan_description"),
        F.col("e.sparkPlanInfo").alias("plan_json"),
        F.col("e.errorMessage").alias("error_message"),
    ).where(F.col("execution_id").isNotNull())


def driver_accum_updates(events: DataFrame) -> DataFrame:
    """``[id, value]`` pairs; shorter ones, and elements that are no array, are skipped."""
    # Each element is parsed on its own: one that is no array must not take the others with it.
    rows = _parsed(events, (DRIVER_ACCUM,), "executionId string, accumUpdates array<string>")
    return (
        rows.select("log_id", "seq", lenient_long(F.col("e.executionId")).alias("execution_id"),
                    F.posexplode("e.accumUpdates").alias("pos", "element"))
        .withColumn("pair", F.from_json(F.when(F.col("element").startswith("["), F.col("element")), "array<string>"))
        .where((F.size("pair") >= 2) & F.col("execution_id").isNotNull())
        .select("log_id", "seq", "pos", "execution_id",
                F.coalesce(lenient_long(F.get("pair", F.lit(0))), F.lit(0)).alias("accumulator_id"),
                F.get("pair", F.lit(1)).alias("value"))
    )
