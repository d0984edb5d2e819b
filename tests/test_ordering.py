import random

from pyspark.sql import functions as F

from jobscope.operators.findings import complete_instance_ids, duplicate_instance_ids
from jobscope.operators.attempts import logical_tasks
from jobscope.operators.order_stats import histogram_bucket, order_statistics, sorted_samples, value_counts
from jobscope.ordering import carry_forward, make_seq, number_rows, seq_bucket


def seq(block, line):
    return make_seq(F.lit(1), F.col(block) * 4096 + F.col(line)).alias("seq")


def events(spark, n=3000, seed=1):
    rng = random.Random(seed)
    # one group holds a third of all rows
    return [("hot" if i % 3 == 0 else f"g{rng.randrange(20)}", rng.randrange(1 << 20), i,
             rng.choice([None, None, rng.randrange(9)])) for i in range(n)]


def test_number_rows(spark):
    data = events(spark)
    df = spark.createDataFrame(data, "g string, b bigint, l bigint, v int").select("*", seq("b", "l"))
    got = {(r["g"], r["b"], r["l"]): r["n"] for r in
           number_rows(df, ["g"], [seq_bucket(F.col("seq"))], [F.col("seq")], "n").collect()}
    want = {}
    for g in {d[0] for d in data}:
        for i, d in enumerate(sorted(x[:3] for x in data if x[0] == g)):
            want[d] = i + 1
    assert got == want


def test_carry_forward(spark):
    data = events(spark, seed=2)
    df = spark.createDataFrame(data, "g string, b bigint, l bigint, v int").select("*", seq("b", "l"))
    got = {(r["g"], r["b"], r["l"]): r["last"] for r in carry_forward(df, ["g"], "seq", "v", "last").collect()}
    want, last = {}, {}
    for g, b, l, v in sorted(data, key=lambda d: d[:3]):
        last[g] = v if v is not None else last.get(g)
        want[(g, b, l)] = last[g]
    assert got == want


def nearest(values, share):
    from math import ceil
    return values[max(0, min(len(values) - 1, ceil(share * len(values)) - 1))]


def middle(values):
    n = len(values)
    return values[n // 2] if n % 2 else values[n // 2 - 1] + (values[n // 2] - values[n // 2 - 1]) // 2


def test_order_statistics(spark):
    rng = random.Random(3)
    draws = {
        0: [rng.randrange(100) for _ in range(501)],
        1: [rng.randrange(1 << 62) for _ in range(400)],
        2: [-5, 3], 3: [(1 << 53) + 1], 4: [7] * 250 + [1 << 43] * 250, 5: [1, 2],
        6: [rng.randrange(1 << 22) for _ in range(3000)],
        7: [-rng.randrange(1 << 50) for _ in range(99)],
    }
    rows = [("log", s, 0, v) for s, vs in draws.items() for v in vs] + [("log", 0, 0, None)]
    tasks = spark.createDataFrame(rows, "log_id string, stage_id int, stage_attempt_id int, v bigint").select(
        "log_id", "stage_id", "stage_attempt_id", F.struct(F.col("v").alias("duration_ms")).alias("first"))
    counts = value_counts(tasks, ("duration_ms",))
    got = {r["stage_id"]: (r["median"], r["p95"], r["p99"]) for r in order_statistics(counts).collect()}
    want = {}
    for s, vs in draws.items():
        vs = sorted(vs)
        want[s] = (middle(vs), nearest(vs, 0.95), nearest(vs, 0.99))
    assert got == want
    runs = {}
    for r in sorted_samples(counts).collect():
        runs.setdefault(r["stage_id"], []).append((r["first_rank"], r["value"], r["n"]))
    for s, vs in draws.items():
        flat = [v for _, v, n in sorted(runs[s]) for _ in range(n)]
        assert flat == sorted(vs)


def test_instance_ids(spark):
    given = {"a": [None, "bottleneck-1", "", "mine", "bottleneck-3", None, "bottleneck-04", None],
             "b": [f"bottleneck-{i}" for i in range(1, 6)] + [None, None, "bottleneck-6"], "c": [None, None]}
    rows = [(log, i, g) for log, gs in given.items() for i, g in enumerate(gs)]
    df = spark.createDataFrame(rows, "log_id string, position bigint, given_id string")
    got = {}
    out = complete_instance_ids(df)
    for r in out.collect():
        got.setdefault(r["log_id"], {})[r["position"]] = r["instance_id"]
    for log, gs in given.items():
        used, want, nxt = {g for g in gs if g and g.strip()}, [], 1
        for g in gs:
            if not (g and g.strip()):
                while f"bottleneck-{nxt}" in used:
                    nxt += 1
                g = f"bottleneck-{nxt}"
                used.add(g)
            want.append(g)
        assert [got[log][i] for i in range(len(gs))] == want
    assert duplicate_instance_ids(out).count() == 0


def test_buckets_follow_the_order(spark):
    rows = [(b, n) for b in (0, 1, 40_000, 5_000_000) for n in (0, 5, 20_000, 4_000_000)]
    df = spark.createDataFrame(rows, "block long, line long").select(
        seq("block", "line"))
    buckets = [r["b"] for r in df.orderBy("seq").select(seq_bucket(F.col("seq")).alias("b")).collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 4


def test_places_beyond_their_range_are_the_last(spark):
    df = spark.createDataFrame([(1, 5), (1, 1 << 41), (1 << 50, 3), (2, 0)], "f long, at long").select(make_seq(F.col("f"), F.col("at")))
    values = [r[0] for r in df.collect()]
    assert values[0] < values[1] < values[3] < values[2]


def test_histogram_buckets_follow_the_values(spark):
    edges = [s * ((1 << p) + d) for p in range(63) for d in (-1, 0, 1) for s in (1, -1)] + [(1 << 63) - 1, -(1 << 63), 0]
    rng = random.Random(4)
    values = sorted({v for v in edges if -(1 << 63) <= v < 1 << 63} | {rng.randrange(-(1 << 62), 1 << 62) >> rng.randrange(62) for _ in range(3000)})
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", histogram_bucket(F.col("v")).alias("b"))
    got = [r["b"] for r in df.orderBy("v").collect()]
    assert got == sorted(got)
    assert all(b == v for v, b in zip(values, got) if 0 <= v < 256)
    width = {}
    for v, b in zip(values, got):
        width.setdefault(b, []).append(abs(v))
    assert all(max(vs) - min(vs) <= max(vs) / 250 for vs in width.values() if max(vs) > 256)


def test_first_success_is_folded_without_sorting(spark):
    attempts = spark.createDataFrame([("a", 1, 0, i % 5, i, True, False, "Success", 1, 2, 3, 4, "e", "h", i) for i in range(50)],
        "log_id string, stage_id int, stage_attempt_id int, task_index long, task_id long, success boolean, speculative boolean, "
        "reason string, duration_ms long, shuffle_read_bytes long, memory_bytes_spilled long, disk_bytes_spilled long, "
        "executor_id string, host string, seq long")
    plan = logical_tasks(attempts)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan and plan.count("HashAggregate") >= 2
