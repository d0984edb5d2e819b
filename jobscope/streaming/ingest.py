"""Incremental ingest of logs that grow while their applications run."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobscope.operators.attempts import ATTEMPT, STAGE
from jobscope.sources.eventlog import is_event_file, list_files, order_lines, scan_lines
from jobscope.sources.events import recognise_lines

#: Bytes, or lines of a compressed file, that one task writes.
CHUNK_BITS = 27
KNOWN_FILES = "path string, name string, length bigint, modified timestamp"
PARTIAL = ("attempts", "successes", "failures", "success_ms", "failed_ms", "speculative")

TOTALS = "log_id string, stage_id int, stage_attempt_id int, " + ", ".join(f"{c} bigint" for c in PARTIAL)
FOLD_EVERY = 16


def _run_folder(target: str, checkpoint: str) -> str:
    """Batch numbers count from the checkpoint, so each checkpoint writes into a folder of its own."""
    return f"{target}/run={hashlib.md5(checkpoint.encode()).hexdigest()}"


def _parts(spark: SparkSession, run: str, kind: str) -> list[int]:
    """Numbers of the complete ``kind=N`` folders of a run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [status.getPath() for status in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{kind}=")
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _live_parts(spark: SparkSession, run: str, through: int | None = None) -> list[str]:
    """The folders that make up a run's totals (up to a batch): the last base, and the batches after it."""
    bases = [n for n in _parts(spark, run, "base") if through is None or n < through]
    base = bases[-1] if bases else -1
    batches = [n for n in _parts(spark, run, "batch") if n > base and (through is None or n <= through)]
    return [*([f"{run}/base={base}"] if bases else []), *[f"{run}/batch={n}" for n in batches]]


def _fold_in(spark: SparkSession, run: str, batch_id: int) -> None:
    """Totals up to a batch become one base; what the base before it already held is removed.

    A batch that is repeated after a failure finds all parts since the last base, and so writes the same base again.
    """
    older = [n for n in _parts(spark, run, "base") if n < batch_id]
    _sums(spark.read.schema(TOTALS).parquet(*_live_parts(spark, run, batch_id))).write.mode("overwrite").parquet(f"{run}/base={batch_id}")
    if older:
        for n in [n for n in _parts(spark, run, "batch") if n <= older[-1]]:
            _drop(spark, f"{run}/batch={n}")
        for n in older[:-1]:
            _drop(spark, f"{run}/base={n}")


def _append_once(run: str, transform: Callable[[DataFrame], DataFrame], fold_every: int) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch into a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{run}/batch={batch_id}")
        if (batch_id + 1) % fold_every == 0:
            _fold_in(batch.sparkSession, run, batch_id)

    return write


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def stream_event_lines(spark: SparkSession, source: str, target: str) -> int:
    """One micro-batch of ingest: the recognised events of files that are new or have grown; returns their number.

    A streaming file source takes each path once and would miss lines appended to it later, and it reads framed files
    as text.  So files are compared with those ingested before by path, length and time, and whatever changed goes
    through the batch scan, framed files included.  The events of a file have a folder of their own, which is replaced
    as a whole: a batch that is repeated after a failure changes nothing.  Events are stored with their place in their
    file; which log a file belongs to, and its place there, is decided on reading, when all files are known.
    """
    listing = list_files(spark, source)
    known = _stored(spark, f"{target}/files", KNOWN_FILES)
    changed = listing.where(is_event_file(F.col("name"))).join(
        known, ["path", "length", "modified"], "left_anti").select(*listing.columns)
    rows = changed.collect()  # as the listing itself, this is known to the driver
    if not rows:
        return 0
    # a file's events go to few tasks, each of which writes a chunk of the file
    (recognise_lines(scan_lines(spark, [r["place_to_read"] for r in rows])).withColumn("file", F.hex(F.xxhash64("path")))
     .repartition("file", F.shiftright("at", CHUNK_BITS))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("file").parquet(f"{target}/events"))
    (spark.createDataFrame(rows, listing.schema).drop("place_to_read").coalesce(1)
     .write.mode("append").parquet(f"{target}/files"))
    return len(rows)


def read_event_lines(spark: SparkSession, target: str, folder_is_log: bool = False) -> DataFrame:
    """All events ingested so far, ``(log_id, seq, event, value)``."""
    lines = _stored(spark, f"{target}/events", "path string, name string, at bigint, event string, value string")
    files = _stored(spark, f"{target}/files", KNOWN_FILES).dropDuplicates(["path"])
    return order_lines(lines, files, folder_is_log)


def follow_event_lines(spark: SparkSession, source: str, target: str, interval: str = "1 minute") -> StreamingQuery:
    """:func:`stream_event_lines` at every tick of a streaming query."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.trigger(processingTime=interval)
            .foreachBatch(lambda batch, batch_id: stream_event_lines(spark, source, target) and None).start())


def attempt_totals(attempts: DataFrame) -> DataFrame:
    """Additive counters per stage attempt."""
    ok = F.col("success")
    return attempts.where(F.col("stage_id").isNotNull()).groupBy(*ATTEMPT).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("success_ms"),
        F.coalesce(F.sum(F.when(~ok, F.col("duration_ms"))), F.lit(0)).alias("failed_ms"),
        F.count_if(ok & F.col("speculative")).alias("speculative"))


def _sums(partial: DataFrame) -> DataFrame:
    return partial.groupBy(*ATTEMPT).agg(*[F.sum(c).alias(c) for c in PARTIAL])


def stream_stage_totals(attempts: DataFrame, target: str, checkpoint: str, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Keep partial counters per micro-batch; each batch shuffles only its own new attempts.

    After every ``fold_every`` batches the totals so far are written as one table, so what is stored and read is bounded
    by the number of stage attempts, however long the stream runs.
    """
    return (
        attempts.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(_append_once(_run_folder(target, checkpoint), attempt_totals, fold_every)).start()
    )


def read_stage_totals(spark: SparkSession, target: str, checkpoint: str) -> DataFrame:
    """Counters of every stage attempt that the stream with this checkpoint has seen so far; none before its first batch."""
    parts = _live_parts(spark, _run_folder(target, checkpoint))
    return _sums(spark.read.schema(TOTALS).parquet(*parts) if parts else spark.createDataFrame([], TOTALS))


def latest_totals(totals: DataFrame) -> DataFrame:
    """Counters of each stage's highest attempt; older attempts stay stored, so late events never replace newer ones."""
    body = F.struct("stage_attempt_id", *PARTIAL)
    return totals.groupBy(*STAGE).agg(F.max_by(body, "stage_attempt_id").alias("t")).select(*STAGE, "t.*")
