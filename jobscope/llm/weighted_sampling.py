"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import SPACES, store, whole

#: Samples of a signature, and how many of them one row of the sampling stage works out: generated code of that size
#: is still compiled by the JVM.
SAMPLES, AT_ONCE = 40, 2
_LOW = 0xFFFFFFFF
_PIECE_BITS = 21


def paired_terms(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, own, edited`` for each distinct word of ``text`` or of ``edited``: a 64-bit hash, and the logarithm
    of how often it occurs in either, null where it doesn't.

    Both texts share most of their words, so these are counted together.  Where rows are dealt by their keys, nothing is
    shuffled.
    """
    texts = pairs.select(*keys, F.explode(F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("side")),
                                                  F.struct(F.col("edited").alias("text"), F.lit(1).alias("side")))).alias("t"))
    words = texts.select(*keys, "t.side", F.explode(F.split("t.text", SPACES)).alias("word")).filter("word <> ''")
    counts = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(
        F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("edited"))
    known = lambda n: F.log(F.when(F.col(n) > 0, F.col(n))).alias(n)
    return counts.select(*keys, "term", known("own"), known("edited"))


def _sampled(terms: DataFrame, keys: list[str]) -> DataFrame:
    """The variables of ``AT_ONCE`` samples of each term: ``r`` and ``c`` are gamma(2, 1), ``b`` uniform, all fixed by
    term and sample; ``c`` stands as its logarithm.  Hashes and logarithms are taken once, whatever number of weights
    is drawn with them."""
    parts = F.sequence(F.lit(0), F.lit(SAMPLES // AT_ONCE - 1))
    rows = terms.select(*keys, "term", "own", "edited", F.explode(parts).alias("part"))
    salt = F.col("part") * (2 * AT_ONCE)
    hashed = rows.select("*", *[F.xxhash64("term", salt + k).alias(f"h{k}") for k in range(2 * AT_ONCE)])

    def piece(h: Column, bits: int, at: int) -> Column:
        return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)

    columns = []
    for i in range(AT_ONCE):
        h, g = F.col(f"h{2 * i}"), F.col(f"h{2 * i + 1}")
        columns += [(-F.log(piece(h, _PIECE_BITS, 43) * piece(h, _PIECE_BITS, 22))).alias(f"r{i}"),
                    piece(h, _PIECE_BITS, 1).alias(f"b{i}"), F.log(-F.log(piece(g, 32, 32) * piece(g, 32, 0))).alias(f"c{i}")]
    return hashed.select(*keys, "part", "term", "own", "edited", *columns)


def _drawn(log_weight: str, i: int) -> Column:
    """One consistent weighted sample of a weighted term, packed so that the least value of all terms is drawn.

    The weight is taken down to the grid of its ``r`` (step ``t``), and the term competes with
    ``ln a = ln c - r (t - b) - r``.  The upper half of the result orders by that, the lower half tells term and step.
    """
    r, b, c = F.col(f"r{i}"), F.col(f"b{i}"), F.col(f"c{i}")
    t = F.floor(F.col(log_weight) / r + b)
    value = c - r * (t - b) - r
    rank = F.floor((F.greatest(F.lit(-63.0), F.least(F.lit(63.0), value)) + 64.0) * float(1 << 24)).cast("bigint")
    told = F.col("term").bitwiseXOR(t * 2654435761).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(rank, 32).bitwiseOR(told)


def signatures(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, own, edited``: the terms drawn from ``text`` and from ``edited``, 32 bits each, nulls for a text without
    words.  A pair without words has no row.

    The least of each sample is folded before the shuffle, which then carries a few rows for each pair.
    """
    sides = ("own", "edited")
    least = [F.min(_drawn(side, i)).alias(f"{side}{i}") for side in sides for i in range(AT_ONCE)]
    low = lambda x: x.bitwiseAND(F.lit(_LOW))
    parts = _sampled(paired_terms(pairs, keys), keys).groupBy(*keys, "part").agg(*least).select(*keys, F.struct(
        "part", *[F.transform(F.array(*[F.col(f"{side}{i}") for i in range(AT_ONCE)]), low).alias(side) for side in sides])
        .alias("part"))
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return gathered.select(*keys, *[F.flatten(F.col("parts")[side]).alias(side) for side in sides])


def likeness(one: str, two: str) -> Column:
    """Share of equal samples, which estimates the generalised Jaccard similarity of the weighted terms."""
    same = F.aggregate(F.arrays_zip(F.col(one).alias("x"), F.col(two).alias("y")), F.lit(0),
                       lambda n, p: n + p["x"].eqNullSafe(p["y"]).cast("int"))
    return same / float(SAMPLES)


def fingerprint(signature: str) -> Column:
    """A signature as text: eight hex digits a sample, empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def next_documents(ids: DataFrame) -> DataFrame:
    """``key, next`` for each row of ``ids`` (distinct ``key``): the next smaller key, and the largest after the least.

    Keys are dealt out by range and written; windows stay within a range, and ranges meet through their largest keys,
    of which there are as many as ranges.
    """
    ranged = store(ids.repartitionByRange("key").select("key", F.spark_partition_id().alias("range")), "ranges")
    tops = ranged.groupBy("range").agg(F.max("key").alias("top"))
    order = Window.orderBy("range")  # a row for each range
    tops = tops.select("range", F.coalesce(F.lag("top").over(order), F.max("top").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inside = Window.partitionBy("range").orderBy("key")
    return (ranged.withColumn("_next", F.lag("key").over(inside)).join(tops, "range")
            .select("key", F.coalesce("_next", "before").alias("next")))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    The edited text ends, in its last third, with the beginning of the next document's text.  Documents follow each
    other by descending doc_id, a null one last; of rows with one doc_id, the one whose text has the least SHA-256 is
    what the document before them continues with.  A lone document is its own next.  Null texts are empty; texts
    without words have an empty fingerprint and are alike.  Repeated rows and empty tables pass through; further columns
    are ignored.
    """
    least = -(1 << 63)
    id_type = docs.schema["doc_id"].dataType
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("key"), whole().alias("text"))
    sha = F.unhex(F.sha2("text", 256))
    heads = store(texts.select("key", sha.alias("sha"), F.length("text").alias("n"))
                  .groupBy("key").agg(F.min("sha").alias("sha"), F.floor(F.max("n") / 3).alias("cut")), "heads")
    follow = store(next_documents(heads.select("key")), "next")
    asked = store(follow.join(heads.select("key", "cut"), "key")
                  .select(F.col("next").alias("key"), F.col("key").alias("asker"), "cut")
                  .join(heads.select("key", "sha"), "key"), "asked")
    # Every branch below takes (key, text) dealt by key, so that the texts are shuffled once and that is used again;
    # written as an equality, the last condition would become a key of the join and deal them anew.
    begins = (texts.join(asked, "key").filter(F.least("sha", sha) == F.greatest("sha", sha))
              .select(F.col("asker").alias("key"), F.expr("left(text, cut)").alias("begin")).dropDuplicates(["key"]))
    cut = F.floor(F.length("text") / 3)
    edited = texts.join(begins, "key").select(
        "key", "text", F.xxhash64("text").alias("told"), F.length("text").cast("bigint").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut),
                 F.substring(F.col("begin"), F.lit(1), cut)).alias("edited"))
    drawn = signatures(edited.select("key", "told", "text", "edited"), ["key", "told"])
    none = F.array_repeat(F.lit(None).cast("bigint"), SAMPLES)  # a pair without words
    found = store(edited.select("key", "told", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sha.alias("sha"))
                  .join(drawn, ["key", "told"], "left").withColumns({side: F.coalesce(side, none) for side in ("own", "edited")}),
                  "signatures")
    first = found.join(heads.select("key", "sha"), ["key", "sha"]).select("key", "own").dropDuplicates(["key"])
    following = follow.join(first.select(F.col("key").alias("next"), F.col("own").alias("following")), "next")
    return found.join(following.select("key", "following"), "key").select(
        F.when(F.col("key") != least, F.col("key")).cast(id_type).alias("doc_id"), "n_chars", "edited_sha256",
        fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "following").alias("near_next"))
