import binascii
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from jobscope.llm.language_id import accept_languages, fit_languages, held_out, identify_languages, predict_languages
from jobscope.llm.token_counts import TokenCounter, count_tokens, read_cache
from jobscope.session import scratch_path
from tests.llm import edge

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_counter_agrees_with_the_library():
    rnd = random.Random(3)
    alphabet = "aA zé'tsß12³¼.,!?-\n\t\r   日<|endoftext|>ſµ×÷"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    texts += ["", " ", "  ", "a<|endoftext|>b", "it's we'll they've", "\n\n a", "a \n b  "]
    assert TokenCounter(TOKENIZER).count(texts) == library(texts)


def test_cache_encodes_only_what_is_new(spark):
    cache = scratch_path(spark, "test-cache")
    docs = edge.documents(spark)
    first = {r.doc_id: r for r in count_tokens(docs, cache, TOKENIZER, limit=5).collect()}
    want = {i: (len((t or "").encode()), n) for (i, t, *_), n in zip(edge.rows(), library([r[1] or "" for r in edge.rows()]))}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in first.items()} == want
    assert first[1].over_limit and not first[3].over_limit
    distinct = len({r[1] or "" for r in edge.rows()})
    assert read_cache(spark, cache).count() == distinct
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "one new text")], "doc_id long, text string"))
    assert count_tokens(more, cache, TOKENIZER).count() == len(edge.rows()) + 1
    assert read_cache(spark, cache).count() == distinct + 1
    assert count_tokens(edge.empty(spark), cache, TOKENIZER).count() == 0


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, identify_languages(docs)


def test_language_accuracy_on_held_out_documents(predicted):
    docs, told = predicted
    rows = docs.join(told, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(binascii.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, predicted):
    dictionaries = fit_languages(predicted[0].filter(~held_out()))
    assert sorted(dictionaries) == ["de", "en", "es", "fr"]
    told = {r.doc_id: r for r in predict_languages(edge.documents(spark), dictionaries).collect()}
    assert [told[i].lang_pred for i in (2, 3, 4, 9)] == ["und"] * 4 and told[2].score == 0
    assert told[1].lang_pred == "en" and told[5].lang_pred in dictionaries and told[8].lang_pred in dictionaries
    assert predict_languages(edge.empty(spark), dictionaries).count() == 0
    assert {r.lang_pred for r in predict_languages(edge.documents(spark), {}).collect()} == {"und"}
    assert identify_languages(edge.documents(spark)).count() == len(edge.rows())


def test_accepted_rows_are_unchanged(spark):
    docs = edge.documents(spark)
    kept = accept_languages(docs)
    assert kept.columns == docs.columns
    assert set(edge.plain(kept)) <= set(edge.plain(docs))
    assert kept.filter(F.col("text").isNull()).count() == 0
    assert accept_languages(edge.empty(spark)).count() == 0
