import random
import re
import time

import pytest
from pyspark.sql import functions as F

from jobscope.functions.display import human_bytes, human_millis, metric_value, scope_text
from jobscope.functions.plan_text import normalize_plan_text, sort_pushed_filters
from jobscope.plans.flatten import NODE_TYPE
from jobscope.plans.subtrees import duplicate_subtrees, prepare, subtree_digests, subtree_fingerprints

MIB = 1 << 20


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("text, expected", [
    ("Exchange hashpartitioning(id#12L, 200), ENSURE_REQUIREMENTS, [plan_id=77]",
     "Exchange hashpartitioning(id, 200), ENSURE_REQUIREMENTS,"),
    ("HashAggregate(keys=[a#1]) [codegen id : 3]", "HashAggregate(keys=[a])"),
    ("WholeStageCodegen (4)", "WholeStageCodegen"),
    ("ShuffleQueryStage 2", "ShuffleQueryStage"), ("ResultQueryStage 10", "ResultQueryStage"),
    ("BroadcastQueryStage 2", "BroadcastQueryStage 2"),
    ("Range (0, 10)", "Range (0, 10)"), ("a  ,b ( c )\td", "a,b (c) d"), ("   ", ""), (None, ""), (" Sort ", "Sort"),
    ("Scan PushedFilters: [EqualTo(b,2), IsNotNull(a)], x", "Scan PushedFilters: [EqualTo(b,2), IsNotNull(a)], x"),
    ("Scan PushedFilters: [IsNotNull(a), EqualTo(b,2)], x", "Scan PushedFilters: [EqualTo(b,2), IsNotNull(a)], x"),
    ("PushedFilters: [In(a, [3,1]), And(x, Or(b,(c,(d,(e,f)))))]", "PushedFilters: [And(x, Or(b,(c,(d,(e,f))))), In(a, [3,1])]"),
    ("PushedFilters: [b, , a]", "PushedFilters: [a, b]"), ("PushedFilters: []", "PushedFilters: []"),
    ("PushedFilters: [b, a", "PushedFilters: [b, a"),
])
def test_normalize(spark, text, expected):
    assert apply(spark, normalize_plan_text, [text]) == [expected]


def plain_sort(text):
    label = "PushedFilters: ["
    at = text.find(label)
    if at < 0:
        return text
    begin = at + len(label)
    level, end = 1, -1
    for i in range(begin, len(text)):
        level += {"[": 1, "]": -1}.get(text[i], 0)
        if level == 0:
            end = i
            break
    if end < 0:
        return text
    parts, round_, square = [""], 0, 0
    for ch in text[begin:end]:
        if ch == "," and not round_ and not square:
            parts.append("")
            continue
        round_ = max(0, round_ + {"(": 1, ")": -1}.get(ch, 0))
        square = max(0, square + {"[": 1, "]": -1}.get(ch, 0))
        parts[-1] += ch
    kept = sorted(p for p in (re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", p) for p in parts) if p)
    return text[:begin] + ", ".join(kept) + text[end:]


def test_filters_against_plain_code(spark):
    rng = random.Random(4)
    texts = ["x PushedFilters: [" + "".join(rng.choice("ab,,  ()[]") for _ in range(rng.randrange(30)))
             + rng.choice(["", "]", "] PushedFilters: [b, a]"]) for _ in range(600)]
    assert apply(spark, sort_pushed_filters, texts) == [plain_sort(t) for t in texts]


def test_units(spark):
    assert apply(spark, human_bytes, [-5, 0, 1023, 1024, 1280, 1536, MIB, 5 * MIB // 4, 1 << 30, 1 << 40, 1 << 52], "bigint") == [
        "-5 B", "0 B", "1023 B", "1 KiB", "1.2 KiB", "1.5 KiB", "1 MiB", "1.2 MiB", "1 GiB", "1 TiB", "4,096 TiB"]
    assert apply(spark, human_millis, [0, 999, 1000, 1250, 59_999, 60_000, 3_600_000], "bigint") == [
        "0 ms", "999 ms", "1 s", "1.2 s", "60 s", "1 min", "1 hr"]
    for kind, values, expected in [
            ("size", ["512", "1024", "1536", str(3 * MIB), "n/a"], ["512 B", "1 KiB", "1.5 KiB", "3 MiB", "n/a"]),
            ("timing", ["1234"], ["1,234 ms"]), ("nsTiming", ["1234567"], ["1,234,567 ns"]), ("sum", ["1000"], ["1,000"])]:
        assert apply(spark, lambda v, k=kind: metric_value(v, F.lit(k)), values) == expected


def test_scope(spark):
    df = spark.createDataFrame([(3, None), (-1, 7), (-1, None)], "s int, e bigint")
    assert [r[0] for r in df.select(scope_text(F.col("s"), F.col("e"))).collect()] == ["stage 3", "SQL execution 7", "application"]


def random_plan(rng, n):
    """Children arrays of a random tree in pre-order, with few different texts, so that parts repeat."""
    depth, nodes = 1, []
    for i in range(n):
        depth = 1 if i == 0 else rng.randrange(2, depth + 2)
        nodes.append([i, depth, None, 1, 1, rng.choice("AB"), rng.choice("xy"), []])
    for i in range(n - 1, 0, -1):
        parent = max(j for j in range(i) if nodes[j][1] == nodes[i][1] - 1)
        nodes[i][2] = parent
        nodes[parent][3] += nodes[i][3]
        nodes[parent][4] = max(nodes[parent][4], nodes[i][4] + 1)
    return nodes


def plans_of(spark, trees):
    return spark.createDataFrame([("a", i, t) for i, t in enumerate(trees)], f"log_id string, execution_id long, nodes array<{NODE_TYPE}>")


def test_digests_tell_subtrees_apart_as_their_texts_do(spark):
    rng = random.Random(8)
    plans = plans_of(spark, [random_plan(rng, rng.randrange(1, 40)) for _ in range(60)])
    digests = prepare(plans).select("execution_id", F.posexplode(subtree_digests()).alias("ord", "digest"))
    rows = digests.join(subtree_fingerprints(plans), ["execution_id", "ord"]).collect()
    assert len({r["digest"] for r in rows}) == len({r["fingerprint"] for r in rows}) == len({(r["digest"], r["fingerprint"]) for r in rows})
    want = {}
    for r in rows:
        want.setdefault((r["execution_id"], r["fingerprint"]), []).append(r["ord"])
    got = {(r["execution_id"], r["first_ord"]): r["count"] for r in duplicate_subtrees(plans).collect()}
    assert got == {(e, min(o)): len(o) for (e, _), o in want.items() if len(o) > 1}


def test_deep_and_wide_plans_stay_cheap(spark):
    n = 5000
    chain = [[i, i + 1, i - 1 if i else None, n - i, n - i, "Project", "p", []] for i in range(n)]
    wide = [[0, 1, None, n, 2, "Union", "u", []]] + [[i, 2, 0, 1, 1, "Scan", f"s{i % 7}", []] for i in range(1, n)]
    begun = time.time()
    assert prepare(plans_of(spark, [chain])).select(F.size(F.array_distinct(subtree_digests()))).first()[0] == n
    assert prepare(plans_of(spark, [wide])).select(F.size(F.array_distinct(subtree_digests()))).first()[0] == 8
    assert time.time() - begun < 20
