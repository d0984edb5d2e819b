"""Importance resampling towards a target: hashed n-gram features weigh documents, and seeded noise draws among them.

A feature's bucket is the CRC of its bytes.  The CRC of joined texts follows from those of its parts, so the head of the
vocabulary is kept as states: the exact CRC of each frequent word, and state and bucket of each frequent pair.  These
tables are bounded and broadcast.  Features with a word outside the head take the CRC of their bytes directly.  Which
words and pairs are in the head changes the speed, never a bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import store, whole

BUCKETS = 10_000
LONGEST = 3
#: Bounds of the head, and of its words' bytes (longer words are left to the tail): at most 8 MB of words, 4 MB of pairs.
HEAD_WORDS = 1 << 17
HEAD_WORD_BYTES = 64
HEAD_PAIRS = 1 << 18
#: Words worked at once, bytes of one text cut at once, distinct words or pairs counted in a task before they are handed on.
BLOCK = 1 << 17
PIECE = 1 << 20
COUNTED = 1 << 19
LAST_ID = (1 << 63) - 1

# Bytes that stand in words: digits, a-z (A-Z lower-cased) and all beyond ASCII; others part words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shift_tables(longest: int) -> np.ndarray:
    """``[n, k, b]``: what byte ``b`` at place ``k`` of a CRC becomes when ``n`` bytes follow.  CRC is linear, so four
    lookups move a whole state."""
    first = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = first[out[n] & 255] ^ (out[n] >> 8)
    return out


@dataclass(frozen=True)
class Head:
    """Frequent words, most frequent first, and frequent pairs of them as ``first * HEAD_WORDS + second``."""

    words: list[bytes]
    pairs: np.ndarray


class Features:
    """CRCs of all runs of one to three words, from the head where it reaches, else from the bytes."""

    def __init__(self, head: Head) -> None:
        count = len(head.words)
        self.tail, self.stop = count, count + 1
        self.ids = {word: i for i, word in enumerate(head.words)} | {b"": self.stop}
        self.state = np.array([crc32(w) for w in head.words] + [0, 0], np.uint32)
        self.joined = np.array([crc32(b" " + w) for w in head.words] + [0, 0], np.uint32)
        self.place = np.array([len(w) + 1 for w in head.words] + [0, 0], np.int64) * 1024
        self.shift = shift_tables(HEAD_WORD_BYTES + 1).reshape(-1)
        self._keep_pairs(head.pairs)

    def _keep_pairs(self, pairs: np.ndarray) -> None:
        """One pair a slot; of pairs that fall on the same slot the more frequent, which comes first, stays."""
        slots = self._slot(pairs)
        held = np.unique(slots, return_index=True)[1]
        self.pair = np.full(HEAD_PAIRS, -1, np.int64)
        self.pair[slots[held]] = pairs[held]
        self.pair_state = np.zeros(HEAD_PAIRS, np.uint32)
        first, second = pairs[held] // HEAD_WORDS, pairs[held] % HEAD_WORDS
        self.pair_state[slots[held]] = self._append(self.state[first], second)
        self.pair_bucket = self.pair_state % BUCKETS

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x9E3779B1 >> 20) % HEAD_PAIRS

    def _append(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRC of a text with this state, a space and a head word."""
        place, shift = self.place[word], self.shift
        return (shift[place + (state & 255)] ^ shift[place + 256 + (state >> 8 & 255)]
                ^ shift[place + 512 + (state >> 16 & 255)] ^ shift[place + 768 + (state >> 24)] ^ self.joined[word])

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(self.tail)), np.int64, len(words))

    def pair_keys(self, words: list[bytes]) -> np.ndarray:
        ids = self.number(words)
        known = ids < self.tail
        return (ids[:-1] * HEAD_WORDS + ids[1:])[known[:-1] & known[1:]]

    def buckets(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2 and 3 words: where each ends, and its bucket.  Empty words part runs."""
        ids = self.number(words)
        n = len(words)
        tail, inside = ids == self.tail, ids != self.stop
        state = self.state[ids]
        out = []
        for run in range(1, LONGEST + 1):
            if run > n:
                break
            bucket = None
            if run == 2:
                keys = ids[:-1] * HEAD_WORDS + ids[1:]
                slot = self._slot(keys)
                known = self.pair[slot] == keys
                rest = np.flatnonzero(~known)
                state, before = self.pair_state[slot], state
                bucket = self.pair_bucket[slot]
                state[rest] = self._append(before[rest], ids[rest + 1])
                bucket[rest] = state[rest] % BUCKETS
            elif run == 3:
                state = self._append(state[:-1], ids[2:])
            touched, whole_run = tail[:n - run + 1].copy(), inside[:n - run + 1].copy()
            for k in range(1, run):
                touched |= tail[k:n - run + 1 + k]
                whole_run &= inside[k:n - run + 1 + k]
            bucket = state % BUCKETS if bucket is None else bucket
            for p in np.flatnonzero(touched & whole_run).tolist():
                bucket[p] = crc32(b" ".join(words[p:p + run])) % BUCKETS
            starts = np.flatnonzero(whole_run)
            out.append((starts + run - 1, bucket[starts].astype(np.int64)))
        return out


def cut(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, long texts in pieces."""
    text = text.translate(WORD_BYTES)
    start = 0
    while start < len(text):
        end = len(text) if len(text) - start <= PIECE else text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def blocks(texts: Iterator[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of many texts one after another, an empty word after each text; the text's number of each word; and whether
    runs that end there are counted in this block: the last two words of a text cut in pieces lead the next piece."""
    words: list[bytes] = []
    owner: list[tuple[int, int]] = []
    old: list[int] = []

    def made() -> tuple[list[bytes], np.ndarray, np.ndarray]:
        fresh = np.ones(len(words), bool)
        fresh[old] = False
        return words, np.repeat([i for i, _ in owner], [k for _, k in owner]), fresh

    for i, text in enumerate(texts):
        lead: list[bytes] = []
        for piece in cut(text):
            old.extend(range(len(words), len(words) + len(lead)))
            words += lead
            words += piece
            words.append(b"")
            owner.append((i, len(lead) + len(piece) + 1))
            lead = (lead + piece)[1 - LONGEST:]
            if len(words) >= BLOCK:
                yield made()
                words, owner, old = [], [], []
    if words:
        yield made()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (value.as_py() for value in column)


def _data(text: str) -> Column:
    return whole(text).cast("binary").alias("data")


def most_frequent(counts: DataFrame, most: int) -> list[Row]:
    """Rows of ``counts`` from the least ``n`` on at which they are no more than ``most``, most frequent first.

    The least is found by counting rows by steps of an eighth of a power of two, so only rows that stay are fetched.
    """
    step = F.floor(8 * F.log2("n"))
    least, taken = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        taken += row["count"]
        if taken > most:
            break
        least = row.step
    if least is None:
        return []
    return sorted(counts.filter(step >= least).collect(), key=lambda r: (-r.n, r[0]))


def frequent_words(texts: DataFrame) -> list[bytes]:
    """The head words by their counts over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(seen.values(), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for text in _texts(batch.column(0)):
                for words in cut(text):
                    seen.update(w for w in words if len(w) <= HEAD_WORD_BYTES)
                if len(seen) > COUNTED:
                    yield handed()
                    seen.clear()
        yield handed()

    counts = store(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    return [bytes(row.word) for row in most_frequent(counts, HEAD_WORDS)]


def frequent_pairs(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Pairs of head words, most frequent first.  Each task names its most frequent ones out of a bounded table that
    rare pairs leave, so that counts are exact for those that matter and near for the rest."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(Head(sent.value, np.empty(0, np.int64)))
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for found, _, _ in blocks(_texts(batch.column(0))):
                new, n = np.unique(features.pair_keys(found), return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > 2 * COUNTED:
                    best = np.sort(np.argpartition(-counts, COUNTED)[:COUNTED])
                    keys, counts = keys[best], counts[best]
        best = np.argsort(-counts, kind="stable")[:HEAD_PAIRS]
        yield pa.RecordBatch.from_arrays([pa.array(keys[best]), pa.array(counts[best])], names=["pair", "n"])

    counts = store(texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    return np.array([row.pair for row in most_frequent(counts, HEAD_PAIRS)], np.int64)


def bucket_totals(texts: DataFrame, head: Head) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value)
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, _, fresh in blocks(_texts(batch.column(0))):
                for ends, bucket in features.buckets(words):
                    total += np.bincount(bucket[fresh[ends]], minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(spark: SparkSession, corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-odds of each bucket, smoothed by one."""
    rows = [(b, float(s), float(t)) for b, (s, t) in enumerate(zip(corpus.tolist(), target.tolist()))]
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    odds = (F.col("t") + 1) * F.lit(all_s) / ((F.col("s") + 1) * F.lit(all_t))
    made = spark.createDataFrame(rows, "bucket long, s double, t double").select(
        "bucket", F.floor(1000 * F.log(odds)).alias("gain")).collect()
    return np.array([row.gain for row in sorted(made)], np.int64)


def weigh(docs: DataFrame, head: Head, gains: np.ndarray, keep: list[str], text: str) -> DataFrame:
    """``keep`` with ``n_words, n_features, weight`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast((head, gains))
    schema = T.StructType([*docs.select(*keep).schema]).add("n_words", "long").add("weight", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gain = sent.value
        features = Features(table)
        for batch in batches:
            n = batch.num_rows
            count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for words, owner, fresh in blocks(_texts(batch.column(len(keep)))):
                for run, (ends, bucket) in enumerate(features.buckets(words)):
                    ends, bucket = ends[fresh[ends]], bucket[fresh[ends]]
                    # sums of whole numbers below 2**53 are exact
                    weight += np.bincount(owner[ends], gain[bucket], n).astype(np.int64)
                    if run == 0:
                        count += np.bincount(owner[ends], minlength=n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(count), pa.array(weight)],
                                             names=[*keep, "n_words", "weight"])

    runs = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(LONGEST)), F.lit(0))
    return docs.select(*keep, _data(text)).mapInArrow(work, schema).withColumn("n_features", runs.cast("bigint"))


def _noise(seed: int) -> Column:
    """A Gumbel draw of the row's own, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` from 1 up: highest score first, ties to the smaller id, null last.

    Rows are dealt into ranges of the order, which are numbered apart; the start of each follows from the sizes of
    those before it.  ``row`` parts rows that are alike, so no tie is too large for a range.
    """
    order = [F.desc("score"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), F.col("row")]
    ranges = store(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size")).collect()  # one row a partition
    starts, before = [], 0
    for row in sorted(sizes):
        starts.append((row["range"], before))
        before += row["size"]
    begun = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))
    return ranges.join(begun, "range").withColumn(
        "place", F.expr("before + row_number() over (partition by range order by score desc, "
                        f"coalesce(cast(doc_id as bigint), {LAST_ID}), row)")).drop("range", "before")


def _score(docs: DataFrame, target: DataFrame, text: str, target_text: str, seed: int, percent: int, least_words: int,
           more: list[str]) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(_data(text))
    words = frequent_words(texts)
    head = Head(words, frequent_pairs(texts, words))
    gains = bucket_gains(spark, bucket_totals(texts, head), bucket_totals(target.select(_data(target_text)), head))
    scored = store(weigh(docs, head, gains, ["doc_id", *more], text).withColumn("score", F.col("weight") + _noise(seed))
                   .withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.filter(enough).count() // 100
    placed = _ranked(scored.filter(enough).drop(*more))
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    few = scored.filter(~enough).withColumn("place", F.lit(None).cast("bigint"))
    if more:
        placed = placed.select("row", "place").join(scored, "row")
    columns = ["doc_id", "n_features", "weight", "score", "place", *more]
    return placed.select(*columns).unionByName(few.select(*columns)).select("*", rank).drop("place")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             seed: int = 42, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``key, n_features, weight, score, rank`` for each row of ``docs``; ``rank`` is null where the row isn't drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred with the highest scores are drawn, ties to
    the smaller id, null last.  A null text has no words (weight 0); a null id draws the noise of an empty one.  Repeated
    rows are drawn each for itself.  Empty tables give no rows, an empty target gives gains of the corpus alone.  Further
    columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return _score(rows, target, "text", target_text, seed, percent, least_words, []).withColumnRenamed("doc_id", key).select(
        key, "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
                    seed: int = 42, percent: int = 5, least_words: int = 20) -> DataFrame:
    """The drawn rows of ``docs``, all their columns unchanged."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"),
                       F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("packed"))
    scored = _score(rows, target, "text", target_text, seed, percent, least_words, ["packed"])
    return scored.filter("rank is not null").select("packed.*")
