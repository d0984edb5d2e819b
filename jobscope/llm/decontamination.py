"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import document_key, rows_of, store

#: Tokens of a seed, which is also the shortest tile (shorter items are their own seed), and the share of an item's
#: tokens that tiles must cover.
SEED_TOKENS, COVERAGE = 5, 0.6
#: Seeds of the benchmark, and documents with a candidate (16 bytes each), up to which they are sent to every executor.
BROADCAST_SEEDS, BROADCAST_DOCUMENTS = 2_000_000, 1_000_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(hashes: str, size: int) -> Column:
    """Hashes of each ``size`` successive tokens, from their hashes."""
    at = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def tile(document: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in document, place in item, length) of tiles, longest first, none overlapping.

    Each pass hashes windows of ``least`` unmarked tokens by Karp-Rabin, widens the hits to their maximal matches and
    marks the longest; passes go on until no match is left.
    """
    if least < 1 or len(item) < least or len(document) < least:
        return []
    free_d, free_i = [True] * len(document), [True] * len(item)
    top = pow(_BASE, least - 1, _PRIME)
    tiles: list[tuple[int, int, int]] = []

    def windows(sequence: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        value = run = 0
        for at, token in enumerate(sequence):
            if not free[at]:
                value = run = 0
                continue
            if run >= least:
                value = (value - sequence[at - least] * top) % _PRIME
            value = (value * _BASE + token) % _PRIME
            run += 1
            if run >= least:
                yield at - least + 1, value

    while True:
        places: dict[int, list[int]] = {}
        for at, value in windows(item, free_i):
            places.setdefault(value, []).append(at)
        longest, found = 0, []
        for d, value in windows(document, free_d):
            for i in places.get(value, ()):
                if d and i and free_d[d - 1] and free_i[i - 1] and document[d - 1] == item[i - 1]:
                    continue  # not where the match begins
                n = 0
                while d + n < len(document) and i + n < len(item) and free_d[d + n] and free_i[i + n] \
                        and document[d + n] == item[i + n]:
                    n += 1
                if n > longest:
                    longest, found = n, []
                if n == longest and n >= least:
                    found.append((d, i))
        if longest < least:
            return tiles
        for d, i in found:
            if all(free_d[d:d + longest]) and all(free_i[i:i + longest]):
                free_d[d:d + longest] = [False] * longest
                free_i[i:i + longest] = [False] * longest
                tiles.append((d, i, longest))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = SEED_TOKENS) -> DataFrame:
    """``doc, item_id, item_tokens, covered, n_tiles, coverage`` for each document and item whose tokens are covered enough.

    Documents and items that share a seed are candidates, unless the seeds that they share could not cover enough of
    the item.  Tiles may lie anywhere in the document and in any order, so that reordered passages count in full.
    ``doc`` is :func:`document_key`.  Null texts are empty; an item without tokens is never found; items of one id are
    separate if their texts differ.  Empty tables give an empty result.
    """
    items = benchmark.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("item")).filter(F.size("item") > 0) \
        .withColumns({"n": F.size("item"), "size": F.least(F.lit(size), F.size("item")),
                      "h": F.transform("item", lambda w: F.xxhash64(w))})
    items = store(items.withColumn("item_key", F.xxhash64("item_id", "item")), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    wanted = store(
        _any([items.filter(F.col("size") == s).select(F.lit(s).alias("size"), "item_key", F.explode(seeds("h", s)).alias("seed"))
              for s in sizes], items.select("size", "item_key", F.lit(0).cast("bigint").alias("seed")).limit(0))
        .groupBy("size", "item_key", "seed").agg(F.count(F.lit(1)).alias("times")), "seeds")
    if wanted.count() <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    hashed = docs.filter(F.col("text").isNotNull()).select(
        document_key().alias("doc"), F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    shared = hashed.select("doc", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.array_distinct(seeds("h", s)).alias("own"))
                                                      for s in sizes or [size]])).alias("x"))
    shared = shared.select("doc", "x.size", F.explode("x.own").alias("seed")).join(wanted, ["size", "seed"])
    # Repeated rows of a document would count their seeds again; that only lets more candidates through.
    pairs = (shared.groupBy("doc", "item_key").agg(F.sum("times").alias("places"))
             .join(items.select("item_key", "item_id", "n", "size", "h"), "item_key")
             .filter(F.col("places") * F.col("size") >= F.col("n") * coverage))
    asked = store(pairs.groupBy("doc").agg(F.collect_list(F.struct("item_id", "size", "h")).alias("items")), "candidates")
    if asked.count() <= BROADCAST_DOCUMENTS // 10:
        asked = F.broadcast(asked)
    held = docs.filter(F.col("text").isNotNull()).select(
        document_key().alias("doc"), F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("h")) \
        .join(asked, "doc").dropDuplicates(["doc"])
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    arrow_id = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    doc_type = pa.struct([("id", pa.int64()), ("told", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 16):
                out = []
                for doc, own, asked_items in zip(rows["doc"], rows["h"], rows["items"]):
                    for x in asked_items:
                        tiles = tile(own, x["h"], x["size"])
                        covered = sum(n for _, _, n in tiles)
                        if covered >= coverage * len(x["h"]):
                            out.append((doc, x["item_id"], len(x["h"]), covered, len(tiles), covered / len(x["h"])))
                columns = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (doc_type, arrow_id, pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    names=["doc", "item_id", "item_tokens", "covered", "n_tiles", "coverage"])

    return held.mapInArrow(compare, f"doc struct<id:bigint,told:bigint>, item_id {id_type}, item_tokens bigint, "
                                    "covered bigint, n_tiles bigint, coverage double")


def _any(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    for part in parts:
        none = none.union(part)
    return none


def leaks_of_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """:func:`find_leaks` with ``doc_id`` in place of ``doc``."""
    found = find_leaks(docs, benchmark, coverage)
    no_id = (1 << 63) - 1
    doc_id = F.when(F.col("doc.id") != no_id, F.col("doc.id")).cast(docs.schema["doc_id"].dataType)
    return found.select(doc_id.alias("doc_id"), "item_id", "item_tokens", "covered", "n_tiles", "coverage")


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, unchanged, but documents that hold a benchmark item (their repeated rows with them)."""
    found = store(find_leaks(docs, benchmark, coverage).select("doc").distinct(), "leaks")
    if found.count() <= BROADCAST_DOCUMENTS:
        found = F.broadcast(found)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), document_key().alias("doc"))
    return packed.join(found, "doc", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
