import random
import time

from jobscope.llm.line_dedup import common_start, within_one_edit, without_repeats
from pyspark.sql import functions as F
from tests.llm.test_lines_and_simhash import near


def test_one_edit_against_brute_force(spark):
    rnd = random.Random(11)
    texts = ["", "a", "b", "ab", "ba", "aa", "aaa", "aab", "é", "é😀", "😀é", "😀", "a😀b", "ab ", " ab", "a\tb"]
    texts += ["".join(rnd.choice("ab😀é") for _ in range(rnd.randint(0, 9))) for _ in range(120)]
    pairs = [(x, y) for x in texts for y in texts]
    rows = spark.createDataFrame(pairs, "one string, two string").select(
        "*", within_one_edit("one", "two").alias("near"), common_start(F.col("one"), F.col("two")).alias("start")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.near == near(r.one, r.two), r
        assert r.one[:r.start] == r.two[:r.start] and (
            r.start == min(len(r.one), len(r.two)) or r.one[r.start] != r.two[r.start])


def test_long_lines_are_compared_in_a_short_time(spark):
    rnd = random.Random(12)
    line = "".join(rnd.choice("abcdefgé ") for _ in range(20_000))
    pairs = []
    for at in (0, 1, 9_999, 19_998, 19_999):
        pairs += [(line, line[:at] + "X" + line[at + 1:], True), (line[:at] + line[at + 1:], line, True),
                  (line, line[:at] + "X" + line[at:], True), (line[:at] + "XY" + line[at:], line, False),
                  ("Y" + line, line[:at] + "X" + line[at:] if at else line + "X", False)]
    df = spark.createDataFrame(pairs, "one string, two string, wanted boolean").coalesce(1)
    began = time.time()
    assert [r.near for r in df.select(within_one_edit("one", "two").alias("near")).collect()] == [p[2] for p in pairs]
    assert time.time() - began < 20


def test_documents_of_long_near_lines(spark):
    """As the pipeline's stage gets them: every pair of six lines is near or compared in vain."""
    rnd = random.Random(13)
    line = "".join(rnd.choice("abcdefgé ") for _ in range(20_000))
    docs = [(k, line[:9_000 + k] + "X" + line[9_001 + k:]) for k in range(3)] + [(9, line)]
    began = time.time()
    assert sorted(r.doc_id for r in without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [0, 1, 2]
    assert time.time() - began < 60
