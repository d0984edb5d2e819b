import random
import time

from jobscope.llm.line_dedup import differing, within_edits
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_against_brute_force(spark):
    """Each number of edits has its own band; the automaton was for one edit, and then gone."""
    rnd = random.Random(21)
    texts = ["", "a", "b", "ab", "ba", "aa", "é😀", "😀é", "a😀b", " ab", "a\tb", "abcdefgh", "bcdefgha", "abXdeYgh"]
    texts += ["".join(rnd.choice("ab😀") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    pairs = [(x, y) for x in texts for y in texts]
    near = [within_edits(F.col("one"), F.col("two"), k).alias(f"within_{k}") for k in range(5)]
    rows = spark.createDataFrame(pairs, "one string, two string").select(
        "*", *near, differing(F.col("one"), F.col("two")).alias("d")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        far = distance(r.one, r.two)
        assert [r[f"within_{k}"] for k in range(5)] == [far <= k for k in range(5)], r
        assert distance(r.d.a, r.d.b) == far and (r.one != r.two or (r.d.a, r.d.b) == ("", ""))


def test_long_lines_with_edits_far_apart(spark):
    """The whole line lies between the edits, and the automaton still takes a time in proportion to it."""
    rnd = random.Random(22)
    line = "".join(rnd.choice("abcdefgé ") for _ in range(20_000))
    pairs = [("X" + line, line + "Y", False, True, True), ("X" + line[1:], line[:-1] + "Y", False, True, True),
             ("XY" + line, line + "Z", False, False, True), (line[2:], line[:-1], False, False, True),
             ("X" + line[5:], line + "YZ", False, False, False)]
    near = [within_edits(F.col("one"), F.col("two"), k) for k in (1, 2, 3)]
    df = spark.createDataFrame(pairs, "one string, two string, w1 boolean, w2 boolean, w3 boolean").coalesce(1)
    began = time.time()
    assert [tuple(r) for r in df.select(*near).collect()] == [p[2:] for p in pairs]
    assert time.time() - began < 20
