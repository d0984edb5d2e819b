"""Listener files written from line items: what they take on disk, and that the scan finds every line of them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobscope import queries
from jobscope.ordering import count_places
from jobscope.sources import events as ev
from jobscope.sources import listener_lines as ll
from jobscope.sources import tables as tb

N = 6000


@pytest.fixture
def items(spark, tmp_path):
    """A folder with line items: seven a order, keys of four applications."""
    rows = spark.range(N).select(
        F.expr("id div 7").alias("l_orderkey"), F.expr("id % 11 * 35").alias("l_partkey"), F.expr("id % 5").alias("l_suppkey"),
        F.expr("cast(id % 7 + 1 as int)").alias("l_linenumber"), F.expr("cast(id % 50 as double)").alias("l_quantity"),
        F.expr("id % 1000 / 4").alias("l_extendedprice"), F.lit("A").alias("l_returnflag"))
    rows.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def kept(monkeypatch, *modules):
    """The scratch folders that are taken from now on."""
    paths = []
    for module in modules:
        def taken(spark, label, given=module.scratch_path):
            paths.append(given(spark, label))
            return paths[-1]

        monkeypatch.setattr(module, "scratch_path", taken)
    return paths


def files_of(path):
    return [f for f in Path(path.removeprefix("file:")).rglob("*") if f.is_file() and f.name.startswith("part-")]


def plain_bytes(spark, d, *kinds):
    lines = F.array(*[F.expr(ll.LINES[k]) for k in (*kinds, "foreign")])
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("k", F.expr("l_orderkey * 8 + l_linenumber"))
    return rows.select(F.explode(lines).alias("v")).agg(F.sum(F.octet_length("v") + 1)).first()[0]


def test_scan_event_lines_takes_little_disk(spark, items, monkeypatch):
    paths = kept(monkeypatch, ll)
    monkeypatch.setattr(ll, "FILE_ROWS", 500)
    got = {(r.log_id, r.event): (r.lines, r.places) for r in queries.QUERIES["scan_event_lines"](spark, items).collect()}
    stored = files_of(paths[0])
    assert sum(f.stat().st_size for f in stored) < plain_bytes(spark, items, "application", "job", "stage", "sql") / 4
    assert len(stored) >= N / 500
    assert sum(n for n, _ in got.values()) == 4 * N and all(n == places for n, places in got.values())
    assert {log for log, _ in got} == {"a0", "a1", "a2", "a3"}


def test_places_against_distinct_values(spark):
    places = [0, 1, 63, 64, 64, 65, 127, 128, (1 << 62) + 63, (1 << 62) + 63, (1 << 63) - 1, None]
    rows = [(g, p) for g in ("a", None) for p in places] + [("b", None), ("c", 63)]
    got = count_places(spark.createDataFrame(rows, "g string, seq long").repartition(3), ["g"])
    assert {r.g: (r.lines, r.places) for r in got.collect()} == {"a": (12, 9), None: (12, 9), "b": (1, 0), "c": (1, 1)}


def test_stage_accumulables_takes_little_disk(spark, items, monkeypatch):
    paths = kept(monkeypatch, ll)
    rows = ev.stage_accumulables(ll.read_back(spark, items, "accumulables")).collect()
    assert sum(f.stat().st_size for f in files_of(paths[0])) < plain_bytes(spark, items, "accumulables") / 4
    # of five entries, one is not of SQL, one has no value and one no id
    want = sorted((i // 7, p, a, v) for i in range(N) for p, a, v in (
        (0, i % 11 * 35, str(i % 5)), (2, i % 5, str(i % 11 * 35))))
    assert sorted((r.stage_id, r.pos, r.accumulator_id, r.value) for r in rows) == want
    assert {(r.log_id, r.stage_attempt_id) for r in rows} == {(f"a{k}", 0) for k in range(4)}


def test_stream_event_lines_takes_little_disk(spark, items, monkeypatch):
    """Lines and ingested events take a fraction of the text, and every attempt comes back as it was."""
    paths = kept(monkeypatch, queries)
    spark.read.parquet(f"{items}/lineitem.parquet").withColumns({
        "l_extendedprice": F.col("l_extendedprice") + F.col("l_orderkey"), "l_partkey": F.col("l_partkey") + F.col("l_orderkey"),
        "l_returnflag": F.expr("if(l_orderkey % 3 = 0, 'R', 'A')")}).write.parquet(f"{items}/more/lineitem.parquet")
    attempts = tb.attempts(spark, f"{items}/more")
    got = queries.QUERIES["stream_event_lines"](spark, f"{items}/more")
    assert sorted(map(str, got.collect())) == sorted(map(str, attempts.select(*got.columns).collect()))
    plain = tb.task_lines(attempts).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    source, target = (sum(f.stat().st_size for f in files_of(p)) for p in paths)
    assert source < plain / 4 and target < plain / 4
