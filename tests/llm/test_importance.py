import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from jobscope.llm import importance
from jobscope.llm.importance import BLOCK, HEAD_WORDS, Features, Head, blocks, drawn_documents, resample
from jobscope.llm.queries import op12_importance
from tests.llm import edge


def features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), Counter(crc32(r.encode()) % 10000 for r in runs)


def brute(docs, target):
    made = [(i, *features(text)) for i, text in docs]
    corpus, wanted = Counter(), Counter()
    for _, _, f in made:
        corpus.update(f)
    for text in target:
        wanted.update(features(text)[1])
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((corpus[b] + 1) * (t + 10000)))) for b in range(10000)}
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in f.items())
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    place = {id(r): k + 1 for k, r in enumerate(able[:5 * len(able) // 100])}
    return sorted(str((*r[:4], place.get(id(r)))) for r in rows)


def got(df):
    return sorted(str((r[0], r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def test_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    assert got(op12_importance(spark, d)) == brute(docs, target)


def test_edges(spark):
    docs, target = edge.documents(spark), edge.documents(spark).filter("doc_id = 1")
    pairs = [(r[0], r[1]) for r in edge.rows()]
    one = [r[1] for r in edge.rows() if r[0] == 1]
    assert got(resample(docs, target)) == brute(pairs, one)
    assert got(resample(docs, edge.empty(spark))) == brute(pairs, [])
    assert got(resample(edge.empty(spark), target)) == []


def test_drawn_rows_pass_unchanged(spark):
    clash = ("weight", "score", "rank", "row", "place", "range", "packed", "n_words", "data")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("Ab 1 "), 30), "id").alias("text"),
                                   *[F.lit("mine").alias(c) for c in clash])
    target = docs.limit(1).select("text")
    kept = drawn_documents(docs, target)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ranks = resample(docs, target).filter("rank is not null").select("doc_id").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in ranks} and len(rows) == 10 and {r["rank"] for r in rows} == {"mine"}


def test_one_third_of_rows_alike(spark):
    """Repeated rows are drawn each for itself, places stay whole numbers from one up."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text)] * 300 + [(i, f"{text} x{i}") for i in range(100, 700)]
    out = resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), spark.createDataFrame([(text,)], "text string"))
    assert got(out) == brute(rows, [text])


def counted(texts, head):
    total, n = Counter(), [Counter() for _ in texts]
    for words, owner, fresh in blocks(iter(texts)):
        for ends, bucket in Features(head).buckets(words):
            for e, b in zip(ends.tolist(), bucket.tolist()):
                if fresh[e]:
                    total[b] += 1
                    n[owner[e]][b] += 1
    return total, n


def test_any_head_gives_the_same_buckets(monkeypatch):
    """No head, a part, all words, pairs on one slot; texts cut in pieces; blocks of a few words."""
    rng = random.Random(5)
    words = [f"{'ü' * (i % 3)}w{i}" for i in range(30)] + ["long" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))).encode() for _ in range(40)]
    want = [features(t.decode())[1] for t in texts]
    for piece, block in ((1 << 20, BLOCK), (11, 7), (1, 1)):
        monkeypatch.setattr(importance, "PIECE", piece)
        monkeypatch.setattr(importance, "BLOCK", block)
        for size in (0, 1, 12, 30):
            head = [w.encode() for w in words[:size]]
            pairs = np.array([a * HEAD_WORDS + b for a in range(size) for b in range(0, size, 2)], np.int64)
            total, each = counted(texts, Head(head, pairs))
            assert each == want and total == sum(want, Counter())


def test_slots_hold_the_more_frequent_pair():
    words = [f"w{i}".encode() for i in range(2000)]
    pairs = np.arange(2000, dtype=np.int64) * HEAD_WORDS + np.arange(2000)[::-1]
    features_ = Features(Head(words, np.concatenate([pairs, pairs + HEAD_WORDS])))
    held = features_.pair[features_.pair >= 0]
    assert np.isin(pairs, held).mean() > 0.98
    for key in held[:200].tolist():
        text = words[key // HEAD_WORDS] + b" " + words[key % HEAD_WORDS]
        assert features_.pair_state[Features._slot(np.array([key]))[0]] == crc32(text)
