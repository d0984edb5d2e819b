"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from jobscope.llm.common import rows_of, whole

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
#: Distinct word pieces whose counts a task remembers at most; then it starts afresh.
REMEMBERED_PIECES = 1_000_000

# Letters, digits and white space among U+0009 to U+017F, and the pieces into which the byte-level
# tokenizer cuts a text before merging.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
_PIECE = (rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\t\n\r {_LETTERS}{_DIGITS}]+"
          r"|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_PLAIN = "[\t\n\r -~¡-ſ]*"


class TokenCounter:
    """Counts as the ``tokenizers`` library gives them.

    Byte-pair merges never cross the pieces of the byte-level pre-tokenizer, so a text's count is the sum over its
    pieces, and each distinct piece needs the library once.  That way is taken for texts of Latin characters without
    special strings, where the pieces are known exactly; every other text goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_piece = (kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
                         and self.tokenizer.normalizer is None)
        self.pieces, self.plain = re.compile(_PIECE), re.compile(_PLAIN)
        self.known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def count(self, texts: list[str]) -> list[int]:
        plain = [self.by_piece and not any(s in t for s in self.special) and bool(self.plain.fullmatch(t))
                 for t in texts]
        rest = iter(self._encode([t for t, p in zip(texts, plain) if not p]))
        cut = [self.pieces.findall(t) if p else [] for t, p in zip(texts, plain)]
        known = self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED_PIECES:
            known.clear()
            new = set().union(*cut)
        if new:
            pieces = list(new)
            known.update(zip(pieces, self._encode(pieces)))
        return [sum(map(known.__getitem__, c)) if p else next(rest) for c, p in zip(cut, plain)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache so far; empty where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 1024,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit, digest`` for each row of ``docs``.

    Texts are addressed by their SHA-256 and the tokenizer by that of its file.  Digests with a stored count are not
    encoded; of the others each distinct text is encoded once and appended to ``cache_path``, which must be a folder
    that all executors share.  A count never changes once stored, so a repeated append after a failure is harmless.

    Null texts count as empty (0 tokens).  Null keys, repeated rows and empty tables pass through; further columns are
    ignored.  Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(key).alias("doc_id"), whole(text).alias("text")) \
        .withColumn("digest", F.unhex(F.sha2("text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path)
        for batch in batches:
            for rows in rows_of(batch, 64):
                counts = counter.count(rows["text"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(counts), pa.string()), pa.array(rows["digest"], pa.binary()),
                     pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    (texts.select("digest", "text").join(stored, "digest", "left_anti").dropDuplicates(["digest"])
     .mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path))
    counts = (read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return (
        texts.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
        .join(counts, "digest")
        .select(F.col("doc_id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                F.lower(F.hex("digest")).alias("digest"))
    )
