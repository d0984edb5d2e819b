"""Spelling variants: words one edit apart, found by scanning a sorted vocabulary.

Words that follow each other in sorted order share a prefix, and with it the rows of the edit matrix against another
word.  A scan keeps these rows, works on from the shared prefix, and skips all words whose common prefix is already more
than one edit away.  The band holds three diagonals.

The vocabulary is parted into shards of bounded size, so that scans are independent.  Two words one edit apart can be
aligned with the edit where they first differ.  Words of a shard share a prefix; if there are too many of them they are
parted by the letter after it, and the pairs that this separates have their edit exactly there: they agree in all else,
and meet by that.  So every pair is met once, and no shard grows with the frequency of a prefix.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import store, whole

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: How many times as frequent a word's form is.
RATIO = 5
SLIP = 199
#: Words in a shard.  It grows only where that many shards would not do, which bounds the list of those to be parted.
SHARD_WORDS = 1024
MOST_SHARDS = 100_000
#: Words that a task scans.
TASK_WORDS = 1 << 13
COUNTED = 1 << 18
LONG_TEXT = 1 << 20

RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- words -----------------------------------------------------------------------------------------------------------

def slipped(run: str, seed: int, slip: int) -> str:
    """The run as it is counted: one in ``slip`` loses a letter, chosen by the document's id and the run."""
    h = crc32(run.encode(), seed)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """``word, n``: the words of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences over all texts.

    Words are counted in each task first and handed on whenever many distinct ones are held.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1)):
                seed = crc32(f"{doc.as_py()}:".encode())
                lower = data.as_py().translate(LOWER).decode(errors="replace")
                runs = RUN.findall(lower) if len(lower) < LONG_TEXT else (m[0] for m in RUN.finditer(lower))
                for run, n in Counter(runs).items():
                    word = slipped(run, seed, slip)
                    if len(word) >= LEAST_LETTERS:
                        seen[word] += n
                if len(seen) > COUNTED:
                    yield handed()
                    seen.clear()
        yield handed()

    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), whole(text).cast("binary").alias("data"))
    return (texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


# --- the scan --------------------------------------------------------------------------------------------------------
# A row of the banded matrix has three cells: the costs of the candidate's first r letters against r - 1, r and r + 1
# letters of the word, each 0, 1 or 2 (2: too many).  There are 27 rows, numbered in base three, and a step depends on
# the row and on which of three letters of the word equal the candidate's next one.

def _step(row: int, equal: int) -> int:
    left, middle, right = row // 9, row // 3 % 3, row % 3
    a = min(left + (not equal & 1), middle + 1, 2)
    b = min(middle + (not equal & 2), right + 1, a + 1, 2)
    c = min(right + (not equal & 4), b + 1, 2)
    return 9 * a + 3 * b + c


STEP = [_step(row, equal) for row in range(27) for equal in range(8)]
CELL = [(row // 9, row // 3 % 3, row % 3) for row in range(27)]
FIRST, EVEN, LOST = 19, 10, 26  # (2, 0, 1), (1, 0, 1), (2, 2, 2)


def shared_prefixes(words: list[bytes]) -> list[int]:
    """Length of the prefix that each word shares with the one before it."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        n = min(len(a), len(b))
        k = 0
        while k < n and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def near_pairs(words: list[bytes], depth: int = 0) -> Iterator[tuple[int, int]]:
    """Places of all pairs of sorted, distinct words one edit apart that share their first ``depth`` letters."""
    count = len(words)
    lcp = shared_prefixes(words)
    after = [count] * count  # the next place with a shorter shared prefix
    open_: list[int] = []
    for j in range(count):
        while open_ and lcp[open_[-1]] > lcp[j]:
            after[open_.pop()] = j
        open_.append(j)
    rows = [0] * (max(map(len, words), default=0) + 3)
    for i in range(count - 1):
        word, size = b"\0" + words[i] + b"\0\0\0\0", len(words[i])
        j = i + 1
        kept = lcp[j]
        # along the word itself all rows are alike
        rows[:size + 1] = [EVEN] * (size + 1)
        rows[0] = FIRST
        while j < count and kept >= depth:
            candidate = words[j]
            row, r, length = rows[kept], kept, min(len(candidate), size + 2)
            while r < length:
                letter = candidate[r]
                row = STEP[row * 8 + (word[r] == letter) + 2 * (word[r + 1] == letter) + 4 * (word[r + 2] == letter)]
                r += 1
                if row == LOST:
                    break
                rows[r] = row
            j += 1
            if row == LOST or r == size + 2:  # no word that goes on from here comes near again
                while j < count and lcp[j] >= r:
                    j = after[j]
            elif abs(size - len(candidate)) <= 1 and CELL[row][size - len(candidate) + 1] == 1:
                yield i, j - 1
            kept = lcp[j] if j < count else 0


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word, shard by shard; rows come sorted by shard and word, with the shard's ``depth``."""

    def worked(words: list[str], counts: list[int], depth: int) -> pa.RecordBatch:
        near: dict[int, tuple[int, tuple[int, str]]] = {}
        for pair in near_pairs([w.encode("latin-1") for w in words], depth):
            for a, b in (pair, pair[::-1]):
                best = (-counts[b], words[b])
                n, old = near.get(a, (0, best))
                near[a] = n + 1, min(old, best)
        return pa.RecordBatch.from_arrays([
            pa.array([words[i] for i in near], pa.string()), pa.array([n for n, _ in near.values()], pa.int64()),
            pa.array([b[0] for _, b in near.values()], pa.int64()), pa.array([b[1] for _, b in near.values()], pa.string())],
            names=["word", "n_near", "less", "form"])

    held: tuple[int, int] | None = None
    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        for shard, depth, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, depth) != held:
                if len(words) > 1:
                    yield worked(words, counts, held[1])
                held, words, counts = (shard, depth), [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield worked(words, counts, held[1])


# --- shards ----------------------------------------------------------------------------------------------------------

def _common(low: str, high: str) -> Column:
    """Length of the common prefix of two different words."""
    same = F.zip_with(F.split(low, ""), F.split(high, ""), lambda a, b: a.eqNullSafe(b))
    return (F.array_position(same, False) - 1).cast("int")


def _meetings(parted: DataFrame) -> DataFrame:
    """Near words among those whose first difference is at ``at``: they agree in all other letters.

    A meeting holds at most one word for each letter, and one without.
    """
    letter = F.expr("substring(word, at + 1, 1)")
    without = F.expr("concat(left(word, at), substring(word, at + 2))")
    met = parted.select("at", "word", "n", letter.alias("letter"), F.explode(F.array(
        F.struct(without.alias("key"), F.lit(False).alias("full")), F.struct(F.col("word").alias("key"), F.lit(True).alias("full"))
    )).alias("met")).filter("met.full or letter <> ''")
    groups = met.groupBy("at", "met.key").agg(F.collect_list(F.struct("word", "n", "letter", "met.full")).alias("members"))
    near = F.transform("members", lambda m: F.struct(m["word"].alias("word"), F.filter(
        "members", lambda o: (o["letter"] != m["letter"]) & ~(o["full"] & m["full"])).alias("others")))
    each = groups.filter(F.size("members") > 1).select(F.inline(near)).filter(F.size("others") > 0)
    best = F.array_min(F.transform("others", lambda o: F.struct((-o["n"]).alias("less"), o["word"].alias("form"))))
    return each.select("word", F.size("others").cast("bigint").alias("n_near"), best["less"].alias("less"),
                       best["form"].alias("form"))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, less, form``: how many words are one edit away, and the most frequent of them (``-less`` times;
    of equal ones the first in code-point order).  ``words`` is stored, with distinct ``word`` and their ``n``."""
    count = words.count()
    bound = max(shard_words, count // MOST_SHARDS)
    inside = words.select("word", "n", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("shard"))
    leaves: list[DataFrame] = []
    found: list[DataFrame] = []
    while True:
        large = store(
            inside.groupBy("shard").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("low"), F.max("word").alias("high"),
                                        F.max("depth").alias("depth"))
            .filter(F.col("words") > bound).select("shard", F.greatest("depth", _common("low", "high")).alias("at")), "large")
        if large.isEmpty():
            leaves.append(inside)
            break
        # at most MOST_SHARDS rows of two numbers
        met = store(inside.join(F.broadcast(large), "shard", "left"), "shards")
        leaves.append(met.filter("at is null").drop("at"))
        parted = met.filter("at is not null")
        found.append(_meetings(parted))
        inside = parted.filter(F.length("word") > F.col("at")).select(
            "word", "n", (F.col("at") + 1).alias("depth"), F.expr("xxhash64(left(word, at + 1), at)").alias("shard"))
    dealt = reduce(DataFrame.unionByName, leaves).select("shard", "depth", "word", "n")
    # scans cost time, not bytes: their number follows from the words
    scanned = dealt.repartition(count // TASK_WORDS + 1, "shard").sortWithinPartitions("shard", "depth", "word").mapInArrow(
        scan, "word string, n_near long, less long, form string")
    return reduce(DataFrame.unionByName, found, scanned).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best")).select("word", "n_near", "best.*")


def _roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word, root`` for words with a form: each round doubles the steps taken."""
    for _ in range(rounds):
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        forms = store(forms.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return forms


def group_variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words``: distinct ``word`` of letters up to U+00FF, with
    ``n``.  A word's form is its most frequent near word (ties: first in code-point order) if that is at least ``ratio``
    times as frequent; its root is where forms lead."""
    words = store(words.select("word", "n"), "words")
    near = near_words(words, shard_words)
    form = F.when(-F.col("less") >= ratio * F.col("n"), F.col("form"))
    found = store(words.join(near, "word", "left").select(
        "word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(form.isNotNull(), -F.col("less")).alias("form_n")), "forms")
    # each step to a form multiplies the count by the ratio, so paths are short
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = max(1, math.ceil(math.log(max(2.0, (most or 1) / max(1, least or 1)), ratio)) + 1)
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("root")), (steps - 1).bit_length())
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``group_variants`` over the vocabulary of ``docs``.

    A null or empty text has no words; a null id counts as empty where it chooses letters; repeated rows count each
    time; an empty table gives no words.  Further columns are ignored, texts and words are taken whole.
    """
    return group_variants(vocabulary(docs, key, text))
