import hashlib
import random
import re

from pyspark.sql import functions as F

from jobscope.llm.decontamination import leaks_of_documents, tile, without_leaks
from jobscope.llm.disclosure import personal_digests, sanitise, scan_personal
from tests.llm import edge


def brute_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places; only the total is compared."""
    fa, fb, total = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if all(fa[i:i + best]) and all(fb[j:j + best]):
                fa[i:i + best] = fb[j:j + best] = [False] * best
                total += best


def test_tiles_against_brute_force():
    rnd = random.Random(6)
    for _ in range(300):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 40))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 20))]
        least = rnd.randint(1, 5)
        assert sum(n for _, _, n in tile(a, b, least)) == brute_tiles(a, b, least)


def test_leaks_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    cut = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    bench = [(r.item_id, cut(r.text)) for r in items.collect()]
    passage = next(t for _, t in bench if len(t) > 30)
    halves = " ".join(passage[15:]) + " something else between " + " ".join(passage[:15])
    planted = [(9001, " ".join(passage)), (9002, halves.upper()), (9003, " ".join(passage[:8]) + " and no more"),
               (9004, " ".join(reversed(passage)))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.covered for r in leaks_of_documents(both, items).collect()}
    want = {}
    for r in both.collect():
        own = cut(r.text)
        if len(own) > 4000:
            continue
        for i, item in bench:
            if len(set(own) & set(item)) >= 0.3 * len(set(item)):
                n = brute_tiles(own, item, min(5, len(item))) if set(zip(*[own[k:] for k in range(5)])) & set(
                    zip(*[item[k:] for k in range(5)])) else 0
                if n >= 0.6 * len(item):
                    want[r.doc_id, i] = n
    long = {r.doc_id for r in both.collect() if len(cut(r.text)) > 4000}
    assert {k: v for k, v in got.items() if k[0] not in long} == want
    assert {9001, 9002} <= {k[0] for k in got} and not {9003, 9004} & {k[0] for k in got}
    kept = {r.doc_id for r in without_leaks(both, items).collect()}
    assert kept == {r.doc_id for r in both.collect()} - {k[0] for k in got}


def test_leak_edges(spark):
    docs = edge.documents(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "THE cat sat, on the mat!"), (4, "no key"), (4, "no key")],
                                  "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.coverage) for r in leaks_of_documents(docs, items).collect()]
    assert set(got) == {(1, None, 1.0), (7, None, 1.0), (None, 4, 1.0)}
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 8, 9, 10}
    assert edge.plain(without_leaks(docs, items.limit(0))) == edge.plain(docs)
    assert leaks_of_documents(edge.empty(spark), items).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_personal_spans_against_brute_force(spark):
    rnd = random.Random(9)
    odd = ["".join(rnd.choice("a.@-_1 2\n+(é😀") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    odd += ["".join(rnd.choice("0123456789 -..+") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    odd += ["a@b.cd_x@e.f", "1.2.3.4.5.6.7.8", "0255.1.1.001 256.1.1.1", "4111 1111 1111 1111", "x" * 150_000, "1" * 150_000,
            "+1 " + " " * 100_000 + "2", "a@" + "b." * 50_000, "é 4111-1111-1111-1111 +1 (555) 010-9999"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in personal_digests(scan_personal(docs)).collect()}
    for i, t in enumerate(odd):
        want = brute_personal(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t[:200]
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS]
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_disclosing_terms(spark):
    rnd = random.Random(2)
    common = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    prose = lambda: " ".join(rnd.choice(common) for _ in range(12))
    docs = [(i, prose()) for i in range(200)]
    docs += [(300 + i, f"{prose()} Zanzibar, {i} wrote to x.y@mail.example.com {prose()}") for i in range(4)]
    docs += [(400, f"{prose()} zanzibar {prose()}"), (401, f"{prose()} other@mail.example.com rare {prose()}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = scan_personal(df)
    rows = {r.doc_id: r for r in personal_digests(found).collect()}
    text = docs[-2][1]
    at = text.index("zanzibar")
    assert re.fullmatch(rf"(term|drop):{at}:{at + 8}", rows[400].spans)
    assert rows[401].spans.count(":") == 2 and rows[401].n_email == 1
    assert all(rows[i].spans == "" for i in range(200))
    clean = {r.doc_id: r.text for r in sanitise(df, found).collect()}
    assert "anzibar" not in "".join(clean.values()) and "@" not in "".join(clean.values())
    assert "[email]" in clean[300] and all(clean[i] == docs[i][1] for i in range(200))


def test_terms_across_lines_and_numbers(spark):
    rnd = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    prose = lambda n=12: " ".join(rnd.choice(common) for _ in range(n))
    docs = [(i, prose()) for i in range(200)]
    near = ["Name: Zanzibar Miller\nmail: x@y.org", "Quuxley, born 1984, card 4111 1111 1111 1111",
            "O'Brien and Jean-Pierre: call +1 (555) 010-9999", "+1 (555) 020-8888, 1.2.3 and 12 of 34\n\n(Wibbleton)",
            "Farawell " + " 77 ".join(["alpha"] * 10) + " other@mail.example.com", "Toofar " + prose(20) + " third@mail.example.com"]
    docs += [(1000 + 10 * k + i, f"{prose()} {t}\n{i} {prose()}") for k, t in enumerate(near) for i in range(4)]
    alone = ["zanzibar", "quuxley", "o'brien", "jean-pierre", "wibbleton", "farawell", "toofar", "jean-pierre-yves"]
    docs += [(2000 + i, f"{prose()} {w} {prose()}") for i, w in enumerate(alone)]
    rows = {r.doc_id: r.spans for r in personal_digests(scan_personal(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    text = dict(docs)
    for i, w in enumerate(alone):
        at = text[2000 + i].index(w)
        want = "" if i > 5 else rf"(term|drop):{at}:{at + len(w)}"
        assert re.fullmatch(want, rows[2000 + i]), (w, rows[2000 + i])


def test_personal_edges(spark):
    docs = edge.documents(spark)
    got = personal_digests(scan_personal(docs))
    assert got.count() == len(edge.rows()) and got.filter(F.col("spans") != "").count() == 0
    assert edge.plain(sanitise(docs, scan_personal(docs))) == edge.plain(docs)
    assert personal_digests(scan_personal(edge.empty(spark))).count() == 0
