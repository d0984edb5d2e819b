"""Listener lines written from line items, awkward values included, to put the parsers on real files.

Every line item gives one line of each kind.  The lines of an application are written as text files into a folder of
their own and read back by the event scan, so file selection, log identity, recognition and parsing all take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.session import scratch_path
from jobscope.sources.eventlog import scan_event_lines
from jobscope.sources.events import recognise_events

LOG_FOLDER = r"app=([^/]*)$"
#: Rows of a file, so that files that can't be split are read by many tasks.
FILE_ROWS = 1 << 19

_SQL = "org.apache.spark.sql.execution.ui."
# A value as number, text of a number, text, null or not at all, by line number.
LINES = {
    "application": "concat('{\"Event\":\"SparkListenerApplication', if(l_linenumber % 2 = 0, 'End', 'Start'), "
                   "'\",\"App ID\":\"app_', k, '\",\"App Name\":', if(l_partkey % 3 = 0, 'null', concat('\"n', k, '\"')), "
                   "case l_linenumber % 4 when 0 then concat(',\"Timestamp\":', l_partkey) "
                   "when 1 then concat(',\"Timestamp\":\"', l_partkey, '\"') when 2 then ',\"Timestamp\":\"soon\"' else '' end, '}')",
    "job": "concat('{\"Event\":\"SparkListenerJob', if(l_linenumber % 2 = 0, 'End', 'Start'), "
           "'\",\"Job ID\":', case l_partkey % 5 when 0 then 'null' when 1 then concat('\"', l_orderkey, '\"') else string(l_orderkey) end, "
           "if(l_linenumber % 2 = 0 and l_partkey % 3 > 0, concat(',\"Job Result\":{\"Result\":\"', "
           "if(l_partkey % 3 = 1, 'JobSucceeded', 'JobFailed'), '\"}'), ''), '}')",
    "job_stages": "concat('{\"Event\":\"SparkListenerJobStart\",\"Job ID\":', l_orderkey, ',\"Stage IDs\":[', l_partkey, ',\"', "
                  "l_suppkey, '\",null],\"Stage Infos\":', if(l_linenumber = 7, 'null', concat('[{\"Stage ID\":', l_partkey + 1, '},{}]')), "
                  "case l_linenumber % 3 when 0 then '' when 1 then concat(',\"Properties\":{\"spark.sql.execution.id\":\"', l_orderkey, '\"}') "
                  "else ',\"Properties\":{\"spark.sql.execution.id\":null}' end, '}')",
    "stage": "concat('{\"Event\":\"SparkListenerStage', if(l_linenumber % 2 = 0, 'Completed', 'Submitted'), '\"', "
             "if(l_partkey % 7 = 0, '', concat(',\"Stage Info\":{\"Stage ID\":', l_orderkey, ',\"Stage Attempt ID\":', "
             "if(l_partkey % 2 = 0, 'null', '\"1\"'), ',\"Stage Name\":\"s \\\\\"', k, '\\\\\"\",\"Number of Tasks\":', l_partkey, "
             "if(l_partkey % 3 = 0, ',\"Failure Reason\":\"lost\"', ''), '}')), '}')",
    "accumulables": "concat('{\"Event\":\"SparkListenerStageCompleted\",\"Stage Info\":{\"Stage ID\":', l_orderkey, "
                    "',\"Accumulables\":[{\"ID\":', l_partkey, ',\"Value\":', l_suppkey, ',\"Metadata\":\"sql\"},{\"ID\":1,\"Value\":2},"
                    "{\"ID\":\"', l_suppkey, '\",\"Value\":\"', l_partkey, '\",\"Metadata\":\"sql\"},{\"ID\":3,\"Metadata\":\"sql\"},"
                    "{\"Value\":4,\"Metadata\":\"sql\"}]}}')",
    "sql": f"concat('{{\"Event\":\"{_SQL}SparkListener', case l_linenumber % 4 when 0 then 'SQLExecutionStart' "
           "when 1 then 'SQLAdaptiveExecutionUpdate' when 2 then 'SQLExecutionEnd' else 'DriverAccumUpdates' end, "
           "'\",\"executionId\":', if(l_partkey % 5 = 0, 'null', string(l_orderkey)), ',\"description\":\"d', k, '\",\"time\":\"', l_partkey, "
           "'\",\"errorMessage\":', if(l_partkey % 2 = 0, '\"\"', 'null'), '}')",
    "driver": f"concat('{{\"Event\":\"{_SQL}SparkListenerDriverAccumUpdates\",\"executionId\":', l_orderkey, "
              "',\"accumUpdates\":[[', l_partkey, ',', l_suppkey, '],[3],5,[\"x\",\"y\"],null,[', l_suppkey, ',\"', l_partkey, '\",9]]}')",
    "foreign": "concat('{\"Event\":\"SparkListenerBlockUpdated\",\"x\":', k, '}')",
}


def write_lines(lines: DataFrame, path: str) -> None:
    """Adds ``value`` as text files to a folder for each ``app``, packed as the logs of a history folder usually are.

    Rows should be in the order of ``app`` within their partitions before their lines are made, as these are many times as
    wide: the writer then sorts nothing.
    """
    (lines.select("app", "value").write.mode("append").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_ROWS).partitionBy("app").text(path))


def read_back(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Recognised events of the lines of ``kinds``, with ``log_id`` as the application's name; foreign lines among them."""
    path = scratch_path(spark, "listener")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "*", F.expr("l_orderkey * 8 + l_linenumber").alias("k"), F.expr("concat('a', l_suppkey % 4)").alias("app"))
    of_item = F.concat_ws("\n", *[F.expr(LINES[k]) for k in (*kinds, "foreign")])
    write_lines(items.sortWithinPartitions("app").select("app", of_item.alias("value")), path)
    return recognise_events(scan_event_lines(spark, path, folder_is_log=True)).withColumn(
        "log_id", F.regexp_extract("log_id", LOG_FOLDER, 1))
