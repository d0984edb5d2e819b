import hashlib
import re

import pytest
from pyspark.sql import functions as F

from jobscope.llm.exact_dedup import group_copies, keep_one_copy
from jobscope.llm.queries import ORACLES, op13_exact_dedup
from tests.compare import compare, duck
from tests.llm import edge

SCHEMA = "doc_id long, text string"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for place, (i, text) in enumerate(rows):
        groups.setdefault(normal(text), []).append((-len(text or ""), i if i is not None else 1 << 63, place, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[3], best[3], len(members), m == best, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def test_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    assert compare(spark, duck(d), op13_exact_dedup, ORACLES["op13_exact_dedup"], d) == ""


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert got(group_copies(edge.documents(spark))) == brute(rows)
    assert got(group_copies(edge.empty(spark))) == []
    assert group_copies(edge.empty(spark)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def hard():
    same = [(i, "a b\tc" + " " * (i % 4)) for i in range(400)]
    return [*same, (None, "a b c"), (None, "a b c"), (500, "A b c"), (501, "ab c"), (502, "ab c"), (503, "abc\x0b\x0c"),
            (504, "abd"), (504, "abd"), (505, None), (506, "\n"), (507, "é"), (508, "é"), (509, "😀 x"), (510, "😀x ")]


def test_one_group_with_most_rows(spark):
    rows = hard()
    assert got(group_copies(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


@pytest.mark.parametrize("width", [0, 1])
def test_collisions_are_told_apart(spark, width):
    """Digests of no or one byte: everything, or much, collides."""
    rows = hard()
    weak = lambda text: F.substring(F.unhex(F.md5(text.cast("binary"))), 1, width)
    assert got(group_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), digest=weak)) == brute(rows)


def test_kept_rows_pass_unchanged(spark):
    docs = edge.documents(spark).withColumns({c: F.lit("mine") for c in ("kept", "class", "digest", "normal", "packed", "_hot")})
    kept = keep_one_copy(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = sorted((r.doc_id is None, r.doc_id) for r in rows)
    assert [i for _, i in ids] == [1, 4, 5, 8, 9, 10, None] and {r["class"] for r in rows} == {"mine"}
