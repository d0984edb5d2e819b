import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobscope.llm.mixing import mix_sources
from jobscope.llm.queries import ORACLES, op7_mix_sources
from jobscope.llm.weighted_sampling import fingerprint_edits
from tests.compare import compare, duck
from tests.llm import edge


def words(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", text))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints_against_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy(F.desc("doc_id")).select("doc_id", "text").collect()]
    errors, seen = [], defaultdict(set)
    for i, (k, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(text)
        errors += [(got[k].near_edited - jaccard(words(text), words(edited))),
                   (got[k].near_next - jaccard(words(text), words(following)))]
        seen[text].add(got[k].fingerprint)
    assert all(len(x) == 1 for x in seen.values())
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.085


def test_fingerprint_edges(spark):
    got = fingerprint_edits(edge.documents(spark)).collect()
    assert len(got) == len(edge.rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[4].fingerprint == "" and by_id[4].near_next == 1.0
    assert by_id[1].fingerprint == by_id[7].fingerprint and by_id[3].near_edited == 1.0 and by_id[3].near_next == 1.0
    # after the last document (no doc_id) comes the first (10)
    text = "no key here at all"
    assert by_id[None].edited_sha256 == hashlib.sha256((text[:12] + "x").encode()).hexdigest()
    assert fingerprint_edits(edge.empty(spark)).count() == 0
    alone = fingerprint_edits(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def fill(sizes, weights, total):
    """Targets by dealing the excess again and again."""
    target, open_ = {}, set(sizes)
    left = total
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] <= level * weights[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert compare(spark, duck(d), op7_mix_sources, ORACLES["op7_mix_sources"], d) == ""


def test_mix_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    rows = [(r.doc_id, r.source, sum(words(r.text or "").values())) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken, most = Counter(), defaultdict(int)
    for k, s, n in rows:
        r = got[k]
        assert r.size == n and r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert r.taken <= 2 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
        most[s] = max(most[s], n)
    assert all(abs(taken[s] - targets[s]) <= most[s] for s in sizes)
    assert {k: r.taken for k, r in got.items()} == {r.doc_id: r.taken for r in mix_sources(docs.repartition(7)).collect()}


def test_mix_edges(spark):
    got = mix_sources(edge.documents(spark)).collect()
    assert len(got) == len(edge.rows())
    assert {r.doc_id: r.size for r in got if r.doc_id in (2, 3, 4, 8)} == {2: 0, 3: 0, 4: 0, 8: 3}
    assert mix_sources(edge.empty(spark)).count() == 0
    nothing = mix_sources(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string"))
    assert {(r.taken, r.target) for r in nothing.collect()} == {(0, 0.0)}
