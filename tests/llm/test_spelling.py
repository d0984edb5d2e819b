import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from jobscope.llm.queries import op11_spelling
from jobscope.llm.spelling import group_variants, near_pairs, spelling_variants
from tests.llm import edge


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def words_of(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near_by_brute(words):
    """All pairs that agree without one letter of either, checked by comparing them."""
    met = defaultdict(set)
    for w in words:
        met[w].add(w)
        for i in range(len(w)):
            met[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in met.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def brute(words, near=None):
    near = near_by_brute(words) if near is None else near
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def test_matches_brute_force(spark):
    d = "/root/testdata/sf0.1"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_spelling(spark, d)) == brute(words_of(docs))


@pytest.mark.parametrize("seed", range(40))
def test_scan_meets_all_pairs(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcé"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(150)} | {"x" * 300, "x" * 301})
    found = Counter((words[i], words[j]) for i, j in near_pairs([w.encode("latin-1") for w in words]))
    want = {(a, b) for k, a in enumerate(words) for b in words[k + 1:] if one_edit(a, b)}
    assert set(found) == want and max(found.values(), default=1) == 1
    for depth in (1, 3):
        pairs = {(words[i], words[j]) for i, j in near_pairs([w.encode("latin-1") for w in words], depth)}
        assert pairs == {(a, b) for a, b in want if a[:depth] == b[:depth] and min(len(a), len(b)) >= depth}


@pytest.mark.parametrize("bound", [2, 7, 1000])
def test_shards_lose_nothing(spark, bound):
    """Letters that repeat, a prefix of most words, a prefix that is a word, long words; small shards part many times."""
    rng = random.Random(bound)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 10))) for _ in range(400)}
    words |= {"schiff" + "".join(rng.choice("abÿ") for _ in range(rng.randrange(0, 5))) for _ in range(300)}
    words |= {"q" * 30_000, "q" * 30_001, "q" * 29_999 + "r", "aaaaaa", "aaaaaaa"}
    counts = {w: rng.choice([5, 6, 26, 130, 700, 4000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(group_variants(table, shard_words=bound)) == brute(
        counts, {w: {v for v in words if one_edit(v, w)} for w in words})


def test_edges(spark):
    docs = edge.documents(spark).withColumnRenamed("fp", "word").withColumnRenamed("size", "n")
    assert got(spelling_variants(docs)) == brute(words_of([(r[0], r[1]) for r in edge.rows()]))
    assert got(spelling_variants(edge.empty(spark))) == []
    assert got(spelling_variants(edge.documents(spark).filter("text is null"))) == []


def test_long_text_is_taken_whole(spark):
    rows = [(i, f"Ärger{'x' * i} Straße " * 90_000) for i in range(2)] + [(None, "strasse " * 7)]
    assert got(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(words_of(rows))
