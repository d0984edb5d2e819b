"""Reading event-log files: which files count, which log they belong to, in which order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.ordering import FILE_BITS, make_seq
from jobscope.sources.codecs import FRAMED_SUFFIXES, decode_framed_files

# File names that never hold events, and how rolling parts are named.
STATUS_PREFIX = "appstatus"
ROLLING_NAME = r"^events_(\d+)(?:_|$).*$"
TASK_LINE_BITS = 33
LAST_PART = (1 << FILE_BITS) - 1
#: So many files whose place in their log follows from the listing alone are sent to all tasks; paths and numbers, 50 MB.
LISTED_FILES = 100_000


def is_event_file(file_name: Column) -> Column:
    name = F.lower(file_name)
    return ~(name.startswith(".") | name.endswith(".crc") | name.startswith(STATUS_PREFIX) | (name == "_success"))


def is_framed_file(file_name: Column) -> Column:
    """Compressed in a framing the text source cannot read."""
    return F.lower(file_name).rlike("(" + "|".join(rf"\{s}" for s in FRAMED_SUFFIXES) + ")$")


def log_id_of_path(file_path: Column, file_name: Column, folder_is_log: bool = False, roots: list[str] | None = None) -> Column:
    """Rolling parts belong to the log named by their folder; any other file is a log of its own.

    With ``folder_is_log`` all files of a folder are one log, in the order of their paths.  With ``roots`` every folder
    directly below one of these is a log with all that lies in it, at any depth.
    """
    if roots:
        below = "|".join(re.escape(re.sub(r"^[a-z0-9]+:/*(?=/)", "", r).rstrip("/")) for r in roots)
        found = F.regexp_extract(file_path, rf"^((?:[a-z0-9]+:/*(?=/))?(?:{below})/+[^/]+)/", 1)
        return F.when(found != "", found).otherwise(file_path)
    folder = F.regexp_replace(file_path, r"/[^/]*$", "")
    return folder if folder_is_log else F.when(file_name.rlike(ROLLING_NAME), folder).otherwise(file_path)


def log_layout(files: DataFrame, roots: list[str]) -> DataFrame:
    """Per log below ``roots`` how its files lie, from the listing alone: ``log_id, direct_files, application_folders, status``.

    A log is the files in its folder, or those of the one application folder in it, sub-folders included.  Files beside
    application folders, or several of these, are several applications.
    """
    log = log_id_of_path(F.col("path"), F.col("name"), roots=roots)
    inner = F.regexp_extract(F.expr("substring(path, length(log_id) + 1)"), r"^/+([^/]+)/", 1)
    return (
        files.where(is_event_file(F.col("name"))).withColumn("log_id", log).where(F.col("log_id") != F.col("path"))
        .select("log_id", F.when(inner != "", inner).alias("folder"))
        .groupBy("log_id").agg(F.count_if(F.col("folder").isNull()).alias("direct_files"),
                               F.count_distinct("folder").alias("application_folders"))
        .withColumn("status", F.when((F.col("application_folders") > 1) | (
            (F.col("application_folders") > 0) & (F.col("direct_files") > 0)), "several_applications").otherwise("ok")))


def part_number(file_name: Column) -> Column:
    return F.coalesce(F.regexp_extract(file_name, ROLLING_NAME, 1).try_cast("bigint"), F.lit(LAST_PART))


def base_name(file_path: Column) -> Column:
    return F.regexp_extract(file_path, r"([^/]*)$", 1)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, name, length, modified, place_to_read`` of the files below ``paths``; their contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "length",
                    F.col("modificationTime").alias("modified"), F.col("path").alias("place_to_read")))


def ranked_files(files: DataFrame, folder_is_log: bool = False, roots: list[str] | None = None) -> DataFrame:
    """``path, place`` of files that part numbers alone don't put in order: those of logs in which a number is repeated."""
    keyed = files.where(is_event_file(F.col("name"))).select(
        "path", log_id_of_path(F.col("path"), F.col("name"), folder_is_log, roots).alias("log_id"),
        part_number(F.col("name")).alias("part"))
    of_log = Window.partitionBy("log_id")
    again = F.row_number().over(Window.partitionBy("log_id", "part").orderBy("path")) > 1
    return (
        keyed.withColumn("again", again)
        .withColumn("repeated", F.max("again").over(of_log))
        .withColumn("place", F.row_number().over(of_log.orderBy("part", "path")))
        .where("repeated").select("path", "place"))


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, name, at, value)`` for every non-blank line of every event file under ``paths``.

    Plain, gzip and zstd files go through the text source, which splits plain
    files by itself.  Files in the lz4 and snappy block framings are decoded by
    a separate scan, one file per record.
    """
    text = number_lines(spark.read.option("recursiveFileLookup", "true").text(paths))
    framed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*{" + ",".join(FRAMED_SUFFIXES) + "}").load(paths)
    )
    return text.unionByName(decode_framed_files(framed.select(F.col("_metadata.file_path").alias("path"), "content")))


def order_lines(lines: DataFrame, files: DataFrame, folder_is_log: bool = False, roots: list[str] | None = None) -> DataFrame:
    """``lines`` (``path, name, at`` and more) with ``log_id`` and ``seq`` first, given all files of their logs."""
    ranked = ranked_files(files, folder_is_log, roots)
    listed = ranked.limit(LISTED_FILES + 1).collect()
    if len(listed) <= LISTED_FILES:
        ranked = F.broadcast(lines.sparkSession.createDataFrame(listed, ranked.schema))
    place = part_number(F.col("name"))
    if listed:
        lines = lines.join(ranked, "path", "left")
        place = F.coalesce("place", place)
    rest = [c for c in lines.columns if c not in ("path", "name", "at", "place")]
    return lines.select(log_id_of_path(F.col("path"), F.col("name"), folder_is_log, roots).alias("log_id"),
                        make_seq(place, F.col("at")).alias("seq"), *rest)


def scan_event_lines(spark: SparkSession, paths: str | list[str], folder_is_log: bool = False,
                     folders_are_logs: bool = False) -> DataFrame:
    """``(log_id, seq, value)`` for every non-blank line of every event file under ``paths``.

    With ``folders_are_logs`` each folder directly below one of ``paths`` is one log (see :func:`log_layout`).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return order_lines(scan_lines(spark, paths), list_files(spark, paths), folder_is_log, paths if folders_are_logs else None)


def number_lines(text: DataFrame) -> DataFrame:
    """``path, name, at, value`` of the rows of a text scan; nothing may shuffle before this.

    ``at`` rises along a file: lines before a block take at least as many bytes as they are many.
    """
    name = F.col("_metadata.file_name")
    line = F.monotonically_increasing_id().bitwiseAND((1 << TASK_LINE_BITS) - 1)
    return (
        text.where(is_event_file(name) & ~is_framed_file(name))
        .select(F.col("_metadata.file_path").alias("path"), name.alias("name"),
                (F.col("_metadata.file_block_start") + line).alias("at"), "value")
        .where(F.col("value").rlike(r"\S"))
    )
