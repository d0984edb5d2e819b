import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import jobscope.llm.line_dedup as line_dedup
import jobscope.llm.simhash as simhash
from jobscope.llm.line_dedup import dedup_lines, without_repeats
from jobscope.llm.simhash import components, fingerprint_of, keep_one_of_each, near_pairs, simhash_components
from tests.llm import edge


def near(a, b):
    """Within one edit, by what remains after the common beginning."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute_lines(docs):
    """{doc_id: text} by comparing every line with all earlier ones."""
    firsts = {}
    for k, t in sorted(docs, key=lambda d: d[0]):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" ") and line not in firsts:
                firsts[line] = (k, p)
    order = sorted(firsts, key=firsts.get)
    kept = {x for i, x in enumerate(order) if not (len(x) >= 16 and any(len(y) >= 16 and near(x, y) for y in order[:i]))}
    return {k: None if t is None else "\n".join(
        x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or (x in kept and firsts[x] == (k, p))) for k, t in docs}


def line_documents():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcd é") for _ in range(rnd.randint(10, 40))) for _ in range(40)]

    def changed(s):
        i, c = rnd.randrange(len(s)), rnd.choice("abz")
        return rnd.choice([s[:i] + c + s[i:], s[:i] + s[i + 1:], s[:i] + c + s[i + 1:], s])

    docs = []
    for k in range(40):
        lines = ["" if k % 3 else f"page {k * 7} of the document"]
        for _ in range(rnd.randint(0, 12)):
            s = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                s = changed(s)
            lines.append(s)
        docs.append((k, "\n".join(lines)))
    docs += [(100 + i, f"common template line with value {chr(200 + i)} and the end") for i in range(90)]
    return docs + [(500, None), (501, ""), (502, "\n\n")]


@pytest.mark.parametrize("few", [32, 3])
def test_lines_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    docs = line_documents()
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_line_edges(spark):
    docs = edge.documents(spark)
    rows = dedup_lines(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(edge.rows()) and set(docs.columns) < set(rows[0].asDict())
    assert got[2].text is None and got[3].text == "" and got[7].text == "" and (got[7].n_lines, got[7].n_removed) == (1, 1)
    assert got[5].text == edge.rows()[4][1] and [r.text for r in rows if r.doc_id == 9] == ["12 34 !!"] * 2
    assert {r.doc_id for r in without_repeats(docs).collect()} == {1, 2, 3, 4, 5, None, 8, 9, 10}
    assert without_repeats(docs).columns == docs.columns
    assert dedup_lines(edge.empty(spark)).count() == 0


def brute_fingerprint(text):
    import re

    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    rnd = random.Random(1)
    texts = ["", " \n", "A", "A b", "ÀB c D", "a  b c\x1cd e\tf"]
    texts += [" ".join(rnd.choice(["the", "Cat", "SAT", "é", "x1"]) for _ in range(rnd.randint(3, 60))) for _ in range(60)]
    assert [fingerprint_of(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for x in fps[:40]:
        for _ in range(4):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for x, g in zip(signed, brute_groups(fps)):
        groups.setdefault(g, set()).add(x)
    got = {}
    for x in signed:
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_simhash_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(t or "") for _, t in rows]
    want = {i: (f"{f:016x}", rows[g][0]) for (i, _), f, g in zip(rows, fps, brute_groups(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()} == want


def test_simhash_edges(spark):
    docs = edge.documents(spark)
    got = simhash_components(docs).collect()
    assert len(got) == len(edge.rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].fingerprint == "0" * 16 and by_id[4].component_id == by_id[3].component_id == 2
    assert by_id[7].component_id == 1 and by_id[None].component_id is None
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, None, 8, 9, 10], key=str)
    assert simhash_components(edge.empty(spark)).count() == 0 and keep_one_of_each(edge.empty(spark)).count() == 0


def test_one_row_stays_of_each_component(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("apple", "pear", "plum", "fig")]
    a, b, c, d = texts
    docs = [(1, a), (2, a), (2, b), (3, c), (3, d), (4, d), (None, "alone and without id"), (None, "alone and without id"),
            (None, a), (None, "another text that has no id")]
    got = keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = [(1, a), (2, b), (3, c), (3, d), (None, "alone and without id"), (None, "another text that has no id")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))


def test_clashing_columns_pass_unchanged(spark):
    mine = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
            for c in ("n_lines", "n_removed", "_key", "row", "left", "gone", "_lines", "_stays", "component")}
    docs = edge.documents(spark).withColumns(mine)
    for operator in (without_repeats, dedup_lines, keep_one_of_each):
        out = operator(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in mine)
