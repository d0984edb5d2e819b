"""Both sides of each threshold, on one row per case."""

import pytest
from pyspark.sql import functions as F

from jobscope.operators.rules import Rule, apply_rules, built_in_rules, register_rule
from jobscope.operators.advise import link_recommendations

MIB, GIB = 1 << 20, 1 << 30
BIGINTS = ["completed_tasks", "duration_samples", "duration_avg_ms", "duration_max_ms", "p95_duration_ms", "shuffle_samples",
           "shuffle_total_bytes", "shuffle_max_bytes", "median_shuffle_read_bytes", "p95_shuffle_read_bytes",
           "memory_total_bytes", "disk_total_bytes", "memory_max_bytes", "disk_max_bytes", "median_memory_bytes_spilled",
           "p95_memory_bytes_spilled", "median_disk_bytes_spilled", "p95_disk_bytes_spilled", "all_failed_attempts",
           "all_failed_ms", "speculative_attempts", "speculative_ms", "duplicate_successes", "failed_attempts", "failed_ms"]
WORKER = "struct<workers:bigint,worker_id:string,task_count:bigint,duration_ms:bigint,task_share:double,duration_share:double>"
SCHEMA = ("log_id string, stage_id int, outcome string, completion struct<stage_name:string,failure_reason:string>, "
          f"all_reasons array<string>, attempt_reasons array<string>, executors {WORKER}, hosts {WORKER}, "
          "first_seq bigint, " + ", ".join(f"{b} bigint" for b in BIGINTS))


def base(**values):
    zero = dict.fromkeys(BIGINTS, 0) | {"shuffle_max_bytes": None, "median_shuffle_read_bytes": None, "p95_shuffle_read_bytes": None}
    return {"outcome": "unknown", "all_reasons": [], "attempt_reasons": [], **zero, **values}


def duration(n, avg, top, samples=None):
    return base(completed_tasks=n, duration_samples=n if samples is None else samples, duration_avg_ms=avg, duration_max_ms=top,
                p95_duration_ms=5000)


def shuffle(n, total, median, p95, top):
    return base(completed_tasks=n, shuffle_samples=n, shuffle_total_bytes=total, median_shuffle_read_bytes=median,
                p95_shuffle_read_bytes=p95, shuffle_max_bytes=top)


def tiny(n=100, avg=500, p95=1000, readers=0, total=0, samples=None):
    return base(completed_tasks=n, duration_samples=n if samples is None else samples, duration_avg_ms=avg, duration_max_ms=avg,
                p95_duration_ms=p95, shuffle_samples=readers, shuffle_total_bytes=total)


def spill(n, disk=0, memory=0, top=0):
    return base(completed_tasks=n, disk_total_bytes=disk, memory_total_bytes=memory, disk_max_bytes=top)


def skew(kind, n, median, top):
    return base(completed_tasks=n, **{f"median_{kind}_bytes_spilled": median, f"{kind}_max_bytes": top})


def speculative(n, s):
    return base(completed_tasks=n, speculative_attempts=s)


def worker(n, workers, duration_share, task_share):
    return base(completed_tasks=n, executors=(workers, "e", 1, 1, task_share, duration_share))


CASES = [
    (duration(10, 1000, 3000), ["task_duration_skew:medium"]), (duration(10, 1000, 2999), []), (duration(9, 1000, 9000), []),
    (duration(10, 0, 3000), []), (duration(10, 1000, 3000, samples=9), []),
    (shuffle(10, 400 * MIB, MIB, 2 * MIB, 256 * MIB + 1), ["shuffle_partition_skew:high"]),
    (shuffle(10, 400 * MIB, MIB, 2 * MIB, 256 * MIB), []), (shuffle(10, 400 * MIB, 0, 2 * MIB, 300 * MIB), []),
    (shuffle(9, 400 * MIB, MIB, 256 * MIB, 300 * MIB), ["oversized_shuffle_partitions:medium"]),
    (shuffle(8, 400 * MIB, MIB, 256 * MIB - 1, 2 * GIB - 1), []),
    (shuffle(8, 400 * MIB, MIB, MIB, 2 * GIB), ["oversized_shuffle_partitions:high"]),
    (shuffle(2, 400 * MIB, GIB, GIB, GIB), ["oversized_shuffle_partitions:high"]), (shuffle(1, 400 * MIB, GIB, GIB, GIB), []),
    (shuffle(7, GIB, MIB, MIB, MIB), ["low_shuffle_parallelism:medium"]), (shuffle(8, GIB, MIB, MIB, MIB), []),
    (shuffle(7, GIB - 1, MIB, MIB, MIB), []), (shuffle(4, GIB, MIB, MIB, MIB), []),
    (shuffle(15, 10 * GIB, MIB, MIB, MIB), ["low_shuffle_parallelism:high"]), (shuffle(16, 10 * GIB, MIB, MIB, MIB), []),
    (spill(1, disk=GIB), ["spill_pressure:high"]), (spill(1, disk=GIB - 1), []), (spill(1, memory=4 * GIB), ["spill_pressure:medium"]),
    (spill(1, memory=4 * GIB - 1), []), (spill(2, disk=256 * MIB), ["spill_pressure:medium"]), (spill(2, disk=256 * MIB - 1), []),
    (spill(2, memory=GIB), ["spill_pressure:medium"]), (spill(2, disk=512 * MIB, top=512 * MIB), ["spill_pressure:high"]),
    (spill(0, disk=GIB), []),
    (skew("memory", 10, MIB, 256 * MIB + 1), ["memory_spill_skew:medium"]), (skew("memory", 10, MIB, 256 * MIB), []),
    (skew("memory", 10, 60 * MIB, 300 * MIB), []), (skew("memory", 9, MIB, 300 * MIB), []),
    (skew("disk", 10, MIB, 128 * MIB + 1), ["disk_spill_skew:high"]), (skew("disk", 10, MIB, 128 * MIB), []),
    (tiny(), ["too_many_tiny_tasks:medium"]), (tiny(n=99), []), (tiny(avg=501), []), (tiny(p95=1001), []),
    (tiny(readers=100, total=100 * MIB), ["too_many_tiny_tasks:medium"]), (tiny(readers=10, total=11 * (MIB + 1)), []),
    (tiny(samples=99), []),
    (base(all_failed_attempts=3, all_failed_ms=30_000), ["retry_waste:medium"]), (base(all_failed_attempts=2, all_failed_ms=30_000), []),
    (base(all_failed_attempts=3, all_failed_ms=29_999), []), (base(all_failed_attempts=3, all_failed_ms=300_000), ["retry_waste:high"]),
    (speculative(15, 3), ["speculation_heavy:medium"]), (speculative(16, 3), []), (speculative(10, 2), []),
    (speculative(9, 9), []), (speculative(10, 5), ["speculation_heavy:high"]), # the share is rounded to four digits before it is compared
    (speculative(20000, 3999), ["speculation_heavy:medium"]), (speculative(20000, 3998), []),
    (worker(10, 2, 0.75, 0.5), ["executor_imbalance:medium"]), (worker(10, 1, 1.0, 1.0), []), (worker(10, 2, 0.7499, 0.5), []),
    (worker(10, 2, 0.75, 0.4999), []), (worker(9, 2, 0.9, 0.9), []),
    (base(outcome="failed", completion=(None, " ")), ["failed_stage:high"]), (base(outcome="completed"), []),
]


@pytest.fixture(scope="module")
def fired(spark):
    rows = [{"log_id": "log", "stage_id": i, **case} for i, (case, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in apply_rules(built_in_rules(), "stages", table).collect():
        out.setdefault(r["stage_id"], []).append(f"{r['type']}:{r['severity']}")
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_threshold(fired, i):
    assert fired.get(i, []) == CASES[i][1]


def test_register_rule(spark):
    extra = Rule("busy_stage", "stages", 99, "Stage %d is busy.", F.col("completed_tasks") > 1000, F.lit("low"), {"n": F.col("completed_tasks")})
    found = apply_rules(register_rule(built_in_rules(), extra), "stages",
                        spark.createDataFrame([{"log_id": "log", "stage_id": 1, **base(completed_tasks=2000)}], SCHEMA)).collect()
    assert [(r["type"], r["message"]) for r in found] == [("busy_stage", "Stage 1 is busy.")]
    with pytest.raises(ValueError):
        register_rule(built_in_rules(), Rule("failed_job", "stages", 1, "", F.lit(True), F.lit("low")))


def test_link(spark):
    findings = spark.createDataFrame(
        [("l", 1, "a", 5, "f1"), ("l", 2, "a", 5, "f2"), ("l", 3, "a", 5, "f3"), ("l", 4, "b", -1, "f4")],
        "log_id string, position bigint, type string, stage_id int, instance_id string")
    wanted = [("l", 1, "a", 5, "f2"), ("l", 2, "a", 5, None), ("l", 3, "a", 5, None), ("l", 4, "a", 5, None),
              ("l", 5, "b", -1, "f9"), ("l", 6, "a", 6, "f4")]
    recommendations = spark.createDataFrame(wanted, "log_id string, position bigint, type string, stage_id int, related_id string")
    got = {r["position"]: (r["related_id"], r["status"]) for r in link_recommendations(recommendations, findings).collect()}
    assert got == {1: ("f2", "linked"), 2: ("f1", "linked"), 3: ("f3", "linked"), 4: (None, "unknown finding"),
                   5: ("f9", "unknown finding"), 6: ("f4", "mismatch")}
