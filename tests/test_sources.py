import gzip
import json
import struct

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from jobscope.operators.attempts import logical_tasks, stage_attempt_metrics
from jobscope.ordering import make_seq
from jobscope.plans.flatten import flatten_plans
from jobscope.session import scratch_path
from jobscope.sources import events as ev
from jobscope.sources import tables as tb
from jobscope.sources.eventlog import list_files, log_layout, scan_event_lines
from jobscope.streaming import ingest
from tests.lines import app_end, app_start, completed, job_start, submitted, task, write_log

LINES = [app_start(), job_start(0, [1]), submitted(1), task(1, 0), completed(1), app_end()]


def text(lines=LINES):
    return "".join(json.dumps(x) + "\n\n" for x in lines).encode()


def lz4(data):
    out = b""
    for i in range(0, len(data), 300):
        part = data[i:i + 300]
        body = pa.compress(part, codec="lz4_raw", asbytes=True)
        out += b"LZ4Block" + bytes([0x26]) + struct.pack("<iii", len(body), len(part), 0) + body
    stored = b"\n"
    out += b"LZ4Block" + bytes([0x16]) + struct.pack("<iii", 1, 1, 0) + stored
    return out + b"LZ4Block" + bytes([0x16]) + struct.pack("<iii", 0, 0, 0)


def snappy(data):
    out = b"\x82SNAPPY\x00" + struct.pack(">ii", 1, 1)
    for i in range(0, len(data), 300):
        body = pa.compress(data[i:i + 300], codec="snappy", asbytes=True)
        out += struct.pack(">i", len(body)) + body
    return out


@pytest.mark.parametrize("suffix, pack", [
    ("", bytes), (".gz", gzip.compress), (".zst", zstandard.compress), (".zstd", zstandard.compress), (".lz4", lz4),
    (".snappy", snappy)])
def test_formats(spark, tmp_path, suffix, pack):
    (tmp_path / f"log.json{suffix}").write_bytes(pack(text()))
    rows = scan_event_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [json.loads(r["value"])["Event"] for r in rows] == [x["Event"] for x in LINES]


def test_rolling_order_and_status_files(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app"
    write_log(folder / "events_10_app", [app_end()])
    write_log(folder / "events_2_app", LINES[2:5])
    write_log(folder / "events_1_app", LINES[:2])
    for junk in ("appstatus_app", "AppStatus_x", ".hidden", "x.crc", "_SUCCESS"):
        (folder / junk).write_text("not json\n")
    write_log(tmp_path / "single.json", [app_start("other")])
    rows = scan_event_lines(spark, str(tmp_path)).orderBy("seq").collect()
    logs = {r["log_id"] for r in rows}
    assert len(logs) == 2
    rolled = [json.loads(r["value"])["Event"] for r in rows if r["log_id"].endswith("eventlog_v2_app")]
    assert rolled == [x["Event"] for x in LINES]


def test_split_files_keep_line_order(spark, tmp_path):
    lines = [{"Event": "SparkListenerTaskEnd", "Stage ID": 1, "n": i, "pad": "x" * 200} for i in range(4000)]
    write_log(tmp_path / "big.json", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = scan_event_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        rows = df.repartition(3).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [json.loads(r["value"])["n"] for r in rows] == list(range(4000))


def test_recognition(spark):
    names = {"SparkListenerTaskEnd": True, "x.SparkListenerTaskEnd": False, "SparkListenerSQLExecutionEnd": True,
             "a.b.SparkListenerSQLExecutionEnd": True, "aSparkListenerSQLExecutionEnd": False, "SparkListenerTaskStart": False}
    df = spark.createDataFrame([("log", i, json.dumps({"Event": n})) for i, n in enumerate(names)],
                               "log_id string, seq int, value string")
    assert {r["seq"] for r in ev.recognise_events(df).collect()} == {i for i, ok in enumerate(names.values()) if ok}


def test_lines_and_tables_agree(spark, tmp_path):
    """Attempts written out as listener lines and read back give the same stage metrics."""
    d = "/root/testdata/sf0.001"
    attempts = tb.attempts(spark, d)
    lines = tb.task_lines(attempts).unionByName(tb.stage_lines(tb.stage_events(spark, d)))
    for log in ("app-0", "app-1"):
        ordered = [r["value"] for r in lines.where(f"log_id = '{log}'").orderBy("seq").collect()]
        write_log(tmp_path / log, ordered)
    events = ev.recognise_events(scan_event_lines(spark, str(tmp_path)))
    got = stage_attempt_metrics(logical_tasks(ev.task_attempts(events))).drop("log_id")
    want = stage_attempt_metrics(logical_tasks(attempts.where("log_id in ('app-0', 'app-1')"))).drop("log_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_of_rolling_files(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "events")
    folder = source / "eventlog_v2_a"
    late = [task(1, 1, attempt=1), completed(1, attempt=1)]
    write_log(folder / "events_2_a", late)
    assert ingest.stream_event_lines(spark, str(source), target) == 1
    # an earlier part and late events of an older attempt arrive afterwards
    write_log(folder / "events_1_a", [app_start(), task(1, 0, attempt=0), {"Event": "Other"}])
    assert ingest.stream_event_lines(spark, str(source), target) == 1
    assert ingest.stream_event_lines(spark, str(source), target) == 0
    # a part grows, and a framed one is added
    write_log(folder / "events_2_a", [*late, task(1, 2, attempt=1)])
    (folder / "events_3_a.lz4").write_bytes(lz4(text([task(1, 3, attempt=1), app_end()])))
    assert ingest.stream_event_lines(spark, str(source), target) == 2
    events = ingest.read_event_lines(spark, target)
    stored = events.orderBy("seq").collect()
    assert [r["event"][13:] for r in stored] == ["ApplicationStart", "TaskEnd", "TaskEnd", "StageCompleted", "TaskEnd",
                                                 "TaskEnd", "ApplicationEnd"]
    batch = ev.recognise_events(scan_event_lines(spark, str(source))).orderBy("seq").collect()
    assert [(r["log_id"], r["value"]) for r in stored] == [(r["log_id"], r["value"]) for r in batch]

    totals, checkpoint = scratch_path(spark, "t"), str(tmp_path / "cp2")
    assert ingest.read_stage_totals(spark, totals, checkpoint).count() == 0
    stream = (spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(f"{target}/events"))
    ingest.stream_stage_totals(ev.task_attempts(stream), totals, checkpoint).awaitTermination()
    latest = ingest.latest_totals(ingest.read_stage_totals(spark, totals, checkpoint)).collect()
    assert [(r["stage_id"], r["stage_attempt_id"], r["attempts"]) for r in latest] == [(1, 1, 3)]
    assert ingest.read_stage_totals(spark, totals, str(tmp_path / "other")).count() == 0


def test_files_of_a_folder_as_one_log(spark, tmp_path):
    write_log(tmp_path / "app" / "b.json", [task(1, 0)])
    write_log(tmp_path / "app" / "a.json", [app_start()])
    rows = scan_event_lines(spark, str(tmp_path), folder_is_log=True).orderBy("seq").collect()
    assert len({r["log_id"] for r in rows}) == 1 and "ApplicationStart" in rows[0]["value"]
    assert scan_event_lines(spark, str(tmp_path)).select("log_id").distinct().count() == 2


def test_awkward_values(spark):
    lines = [
        ("a", '{"Event":"SparkListenerDriverAccumUpdates","executionId":1,"accumUpdates":[[1,2],[3],5,[4,6],null,"x"]}'),
        ("b", '{"Event":"SparkListenerApplicationStart","Event":"SparkListenerApplicationStart"}'),
        ("c", '{"Event":"SparkListenerApplicationStart"'), ("d", "5"), ("d", '{"Event":"SparkListenerApplicationEnd"}')]
    rows = spark.createDataFrame(lines, "log_id string, value string").withColumn(
        "seq", make_seq(F.lit(0), F.monotonically_increasing_id()))
    status = {r["log_id"]: r["status"] for r in ev.validate_logs(rows).collect()}
    assert status == {"a": "ok", "b": "ok", "c": "corrupt", "d": "ok"}
    pairs = ev.driver_accum_updates(ev.recognise_events(rows)).collect()
    assert [(r["pos"], r["accumulator_id"], r["value"]) for r in pairs] == [(0, 1, "2"), (3, 4, "6")]


def test_plans_that_are_no_trees(spark):
    deep = '{"nodeName":"A","children":[' * 100_000 + "]}" * 100_000
    plans = spark.createDataFrame([("a", 1, "abc"), ("a", 2, deep), ("a", 3, '{"nodeName":"A"}'), ("a", 4, "[1]")],
                                  "log_id string, execution_id long, plan_json string")
    got = {r["execution_id"]: [n["node_name"] for n in r["nodes"]] for r in flatten_plans(plans).collect()}
    assert got == {1: [None], 3: ["A"], 4: [None]}


@pytest.mark.parametrize("suffix, pack", [(".lz4", lz4), (".snappy", snappy)])
def test_one_damaged_file_marks_its_log(spark, tmp_path, suffix, pack):
    """Cut off inside a block, no framing at all, a length that can't be: other logs carry on."""
    data = pack(text())
    (tmp_path / f"good{suffix}").write_bytes(data)
    (tmp_path / f"cut{suffix}").write_bytes(data[:-len(data) // 3])
    (tmp_path / f"none{suffix}").write_bytes(b"plain text\n")
    (tmp_path / f"wrong{suffix}").write_bytes(data[:200] + b"\xff" * 40 + data[240:])
    (tmp_path / f"empty{suffix}").write_bytes(b"")
    lines = scan_event_lines(spark, str(tmp_path))
    status = {r["log_id"].rsplit("/", 1)[1].split(".")[0]: r["status"] for r in ev.validate_logs(lines).collect()}
    assert status.pop("good") == "ok" and set(status.values()) == {"corrupt"} and {"cut", "none", "wrong"} <= set(status)
    cut = lines.where(F.col("log_id").contains("/cut")).count()
    assert 1 < cut < len(LINES) + 1
    assert lines.where(F.col("log_id").contains("/good")).count() == len(LINES)


def test_line_ends_across_blocks():
    from jobscope.sources.codecs import file_lines

    plain = b"a\r\nb\rc\n\r\nd\r" + b"e" * 1000 + b"\r\n" + "é😀".encode() * 50
    want = [x for x in plain.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n") if x]
    for size in (1, 2, 3, 7, 300):
        out = b""
        for i in range(0, len(plain), size):
            out += b"LZ4Block" + bytes([0x16]) + struct.pack("<iii", len(plain[i:i + size]), len(plain[i:i + size]), 0) + plain[i:i + size]
        assert [x for x in file_lines("x.lz4", out) if x] == want


def test_parts_with_one_number_follow_their_paths(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app"
    write_log(folder / "events_1_b", LINES[2:4])
    write_log(folder / "events_1_a", LINES[:2])
    write_log(folder / "events_2_a", LINES[4:])
    rows = scan_event_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [json.loads(r["value"])["Event"] for r in rows] == [x["Event"] for x in LINES]


def test_one_bad_value_spoils_no_other_plan(spark):
    metric = '{"nodeName":"A","simpleString":"a","metrics":[{"name":"m","accumulatorId":%s,"metricType":"sum"}]}'
    given = {1: metric % "7", 2: metric % "1e400", 3: metric % "99999999999999999999", 4: metric % '"-9223372036854775808"',
             5: '{"nodeName":"\\ud800B","simpleString":"\\udc00"}', 6: metric % "NaN", 7: metric % '"1e5"', 8: "{", 9: metric % "[1]"}
    plans = spark.createDataFrame([("a", i, p) for i, p in given.items()], "log_id string, execution_id long, plan_json string")
    got = {r["execution_id"]: r["nodes"][0] for r in flatten_plans(plans).collect()}
    ids = {i: n["metrics"][0]["accumulator_id"] for i, n in got.items() if n["metrics"]}
    assert ids == {1: 7, 2: 0, 3: 0, 4: -(1 << 63), 6: 0, 7: 0, 9: 0}
    assert (got[5]["node_name"], got[5]["simple_string"], got[8]["node_name"]) == ("?B", "?", None)


def test_totals_of_a_long_stream_stay_few(spark, tmp_path):
    """Folded every third batch; a repeated batch changes nothing."""
    d, source = "/root/testdata/sf0.001", str(tmp_path / "in")
    attempts = tb.attempts(spark, d)
    attempts.repartition(10).write.parquet(source)
    target, checkpoint = scratch_path(spark, "t"), str(tmp_path / "cp")
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.stream_stage_totals(stream, target, checkpoint, fold_every=3).awaitTermination()
    run = ingest._run_folder(target, checkpoint)
    assert ingest._parts(spark, run, "base") == [5, 8] and ingest._parts(spark, run, "batch") == [6, 7, 8, 9]
    want = sorted(map(str, ingest.attempt_totals(attempts).collect()))
    assert sorted(map(str, ingest.read_stage_totals(spark, target, checkpoint).collect())) == want
    ingest._fold_in(spark, run, 8)
    assert sorted(map(str, ingest.read_stage_totals(spark, target, checkpoint).collect())) == want


def test_layout_of_logs(spark, tmp_path):
    write_log(tmp_path / "plain" / "events_1_a", LINES[:3])
    write_log(tmp_path / "plain" / "events_2_a", LINES[3:])
    write_log(tmp_path / "nested" / "app" / "deep" / "events_2_a", LINES[3:])
    write_log(tmp_path / "nested" / "app" / "events_1_a", LINES[:3])
    write_log(tmp_path / "two" / "app1" / "a.json", LINES)
    write_log(tmp_path / "two" / "app2" / "a.json", LINES)
    write_log(tmp_path / "mixed" / "app" / "a.json", LINES)
    write_log(tmp_path / "mixed" / "b.json", LINES)
    (tmp_path / "mixed" / "none").mkdir()
    (tmp_path / "plain" / "none").mkdir()
    (tmp_path / "plain" / "none" / "appstatus_x").write_text("")
    root = str(tmp_path)
    lines = scan_event_lines(spark, root, folders_are_logs=True)
    layout = log_layout(list_files(spark, root), [root])
    status = {r["log_id"].rsplit("/", 1)[1]: r["status"] for r in ev.validate_logs(lines, layout).collect()}
    assert status == {"plain": "ok", "nested": "ok", "two": "several_applications", "mixed": "several_applications"}
    for log in ("plain", "nested"):
        rows = lines.where(F.col("log_id").endswith(f"/{log}")).orderBy("seq").collect()
        assert [json.loads(r["value"])["Event"] for r in rows] == [x["Event"] for x in LINES]
