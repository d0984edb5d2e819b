"""Short builders for listener lines."""

from __future__ import annotations

import json
from pathlib import Path

MIB = 1024 * 1024


def app_start(app="app-1", name="test", time=1000):
    return {"Event": "SparkListenerApplicationStart", "App ID": app, "App Name": name, "Timestamp": time}


def app_end(time=9000):
    return {"Event": "SparkListenerApplicationEnd", "Timestamp": time}


def job_start(job, stages=(), execution=None, infos=()):
    line = {"Event": "SparkListenerJobStart", "Job ID": job, "Stage IDs": list(stages),
            "Stage Infos": [{"Stage ID": s} for s in infos]}
    if execution is not None:
        line["Properties"] = {"spark.sql.execution.id": str(execution)}
    return line


def job_end(job, result="JobSucceeded"):
    return {"Event": "SparkListenerJobEnd", "Job ID": job, "Job Result": {"Result": result} if result else None}


def stage(kind, stage_id, attempt=0, name="work", tasks=1, reason=None, accumulables=None):
    info = {"Stage ID": stage_id, "Stage Attempt ID": attempt, "Stage Name": name, "Number of Tasks": tasks}
    if reason is not None:
        info["Failure Reason"] = reason
    if accumulables is not None:
        info["Accumulables"] = accumulables
    return {"Event": f"SparkListenerStage{kind}", "Stage Info": info}


def submitted(stage_id, **more):
    return stage("Submitted", stage_id, **more)


def completed(stage_id, **more):
    return stage("Completed", stage_id, **more)


def task(stage_id, index, ms=1000, attempt=0, task_id=None, reason="Success", shuffle=None, memory=None, disk=None,
         executor="1", host="h1", speculative=False, **info):
    line = {
        "Event": "SparkListenerTaskEnd", "Stage ID": stage_id, "Stage Attempt ID": attempt,
        "Task End Reason": {"Reason": reason},
        "Task Info": {"Task ID": index if task_id is None else task_id, "Index": index, "Executor ID": executor,
                      "Host": host, "Speculative": speculative, **info}}
    if ms is not None:
        line["Task Info"] |= {"Launch Time": 5000, "Finish Time": 5000 + ms}
    metrics = {}
    if memory is not None:
        metrics["Memory Bytes Spilled"] = memory
    if disk is not None:
        metrics["Disk Bytes Spilled"] = disk
    if shuffle is not None:
        metrics["Shuffle Read Metrics"] = {"Local Bytes Read": shuffle // 2, "Remote Bytes Read": shuffle - shuffle // 2}
    if metrics:
        line["Task Metrics"] = metrics
    return line


def node(name, *children, text=None, metrics=()):
    return {"nodeName": name, "simpleString": name if text is None else text, "children": list(children),
            "metrics": list(metrics)}


SQL = "org.apache.spark.sql.execution.ui.SparkListener"


def sql_start(execution, plan=None, description="query", time=100, text="plan", **more):
    return {"Event": f"{SQL}SQLExecutionStart", "executionId": execution, "description": description, "details": "d",
            "time": time, "physicalPlanDescription": text, "sparkPlanInfo": plan, **more}


def sql_update(execution, plan=None, text=None):
    return {"Event": f"{SQL}SQLAdaptiveExecutionUpdate", "executionId": execution, "sparkPlanInfo": plan,
            "physicalPlanDescription": text}


def sql_end(execution, time=1060, error=None):
    return {"Event": f"{SQL}SQLExecutionEnd", "executionId": execution, "time": time, "errorMessage": error}


def driver_updates(execution, *pairs):
    return {"Event": f"{SQL}DriverAccumUpdates", "executionId": execution, "accumUpdates": [list(p) for p in pairs]}


def write_log(path: Path, lines) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
