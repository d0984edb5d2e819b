"""SimHash near-duplicates: exact pairs within a Hamming distance by vantage-point trees, and their components.

A tree cuts the 64 bits into disjoint blocks, one for each level.  A level holds one vantage pattern for its block; a
node keeps fingerprints within its radius of the pattern inside and the others outside.  A query that lies ``c`` steps
from the boundary cannot reach a partner across it with fewer than ``c`` differing bits in that block, and as blocks
are disjoint these costs add up along a path: a branch is pruned once they exceed the distance asked for.  Every
fingerprint is kept in one shard (leaf) and asked in the shards that its path can still reach, so no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import document_key, packed_rows, rows_of, store, unpacked, whole

WORDS, MAX_BITS, SEED = 3, 3, 42
#: Fingerprints in a shard that the tree's depth aims at, and rows of either side in one block of a shard.
SHARD, BLOCK = 8192, 16384
#: Bound of the sample from which vantage patterns and radii are taken; it does not touch the results.
SAMPLE = 20_000


def fingerprint_of(text: str, words: int = WORDS) -> int:
    """SimHash of a text's word shingles: a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    tokens = text.encode().lower().split()  # bytes: lowers A-Z alone and splits at U+0009 to U+000D and space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    first, last = starts[:-words].tolist(), (starts[words:] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (64 bits in a long) for each row; null texts are empty, and texts without words have 0."""
    kind = docs.select(key).limit(0).toArrow().schema.field(0).type
    schema = f"{docs.select(key).schema.simpleString()[7:-1]}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, 64):
                found = np.array([fingerprint_of(t, words) for t in rows["text"]], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"], kind), pa.array(found)], names=[key, "fp"])

    return docs.select(F.col(key).alias("key"), whole(text).alias("text")).mapInArrow(run, schema)


@dataclass
class VantageTree:
    """``masks[l]`` and ``points[l]``: block and pattern of a level; ``radii[l][node]``: of each of its 2**l nodes."""

    masks: list[int]
    points: list[int]
    radii: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, total: int) -> VantageTree:
        depth = int(max(0, min(32, np.ceil(np.log2(max(total, 1) / SHARD)))))
        width = 64 // depth if depth else 64
        masks = [((1 << width) - 1) << (width * level) for level in range(depth)]
        node = np.zeros(len(sample), dtype=np.int64)
        points, radii = [], []
        for level, mask in enumerate(masks):
            point = int(sample[level % len(sample)]) & mask if len(sample) else 0
            away = np.bitwise_count((sample & np.uint64(mask)) ^ np.uint64(point)).astype(np.int64)
            own = np.full(1 << level, width // 2, dtype=np.int64)
            if len(sample):
                order = np.lexsort((away, node))
                heads = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0])
                sizes = np.diff(np.r_[heads, len(order)])
                # the distance below which lies about half of the node's sample
                own[node[order][heads]] = away[order][heads + (sizes - 1) // 2]
                low = away[order][heads]
                high = away[order][heads + sizes - 1]
                own[node[order][heads]] = np.where((own[node[order][heads]] == high) & (high > low),
                                                   high - 1, own[node[order][heads]])
            points.append(point)
            radii.append(own)
            node = 2 * node + (away > own[node])
        return VantageTree(masks, points, radii)

    def shards(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``fps``, shard) of every shard in which a fingerprint is asked for; with a reach of -1, its own.

        Of two fingerprints that a node parts, the outer one crosses to the inner one's side, and from there on to
        both sides; the inner one need not cross, since each pair has to meet but once.
        """
        index, node = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        home = np.ones(len(fps), dtype=bool)
        left = np.full(len(fps), reach, dtype=np.int64)
        for mask, point, radii in zip(self.masks, self.points, self.radii):
            away = np.bitwise_count((fps[index] & np.uint64(mask)) ^ np.uint64(point)).astype(np.int64)
            radius = radii[node]
            outside = away > radius
            cost = np.where(outside, away - radius, radius + 1 - away)
            cross = np.flatnonzero((cost <= left) & (outside | ~home))
            index = np.r_[index, index[cross]]
            home = np.r_[home, np.zeros(len(cross), dtype=bool)]
            node = np.r_[2 * node + outside, 2 * node[cross] + ~outside[cross]]
            left = np.r_[left, left[cross] - cost[cross]]
        return index, node


def link_block(members: np.ndarray, queries: np.ndarray, reach: int) -> np.ndarray:
    """Links that join the same fingerprints as all pairs of a block within ``reach``: one to the least of each group.

    Members are ordered by their distance to a vantage point, so that a query compares only with the shells that the
    triangle inequality leaves.
    """
    points = np.unique(np.concatenate([members, queries]))
    label = np.arange(len(points))
    vantage = points[len(points) // 2]
    own = np.searchsorted(points, members)
    shell = np.bitwise_count(members ^ vantage).astype(np.int16)
    order = np.argsort(shell, kind="stable")
    own, members, shell = own[order], members[order], shell[order]
    asked = np.searchsorted(points, queries)
    far = np.bitwise_count(queries ^ vantage).astype(np.int16)
    pairs = []
    for distance in np.unique(far):
        rows = np.flatnonzero(far == distance)
        lo, hi = np.searchsorted(shell, [distance - reach, distance + reach + 1])
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            near = np.bitwise_count(queries[part][:, None] ^ members[None, lo:hi]) <= reach
            q, m = np.nonzero(near)
            a, b = asked[part[q]], own[lo + m]
            keep = a != b
            pairs.append(np.stack([a[keep], b[keep]], axis=1))
            if sum(map(len, pairs)) > 500_000:  # a dense block: keep only what joins its groups
                label = merge(label, np.concatenate(pairs))
                pairs = []
    label = merge(label, np.concatenate(pairs) if pairs else np.empty((0, 2), dtype=np.int64))
    linked = np.flatnonzero(label != np.arange(len(points)))
    return np.stack([points[linked], points[label[linked]]], axis=1)


def merge(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Least member of each group once ``pairs`` are joined; ``label`` holds the least members so far."""
    while len(pairs):
        ends = label[pairs]
        pairs = ends[ends[:, 0] != ends[:, 1]]
        if not len(pairs):
            break
        least = label.copy()
        low, high = pairs.min(axis=1), pairs.max(axis=1)
        np.minimum.at(least, high, low)
        while True:
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
        label = least[label]
    return label


def near_pairs(fps: DataFrame, reach: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints of ``fp`` that join all pairs within ``reach`` bits.

    Within a block of a shard the links are reduced to those needed to connect its groups; no pair is lost to them.
    A shard of any size is worked in blocks of about ``BLOCK`` members by ``BLOCK`` queries.
    """
    total = fps.count()
    chance = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.sort(np.array([r[0] for r in fps.filter(chance < min(1.0, SAMPLE / max(total, 1))).collect()],
                              dtype=np.int64).view(np.uint64))
    np.random.default_rng(SEED).shuffle(sample)
    tree = VantageTree.fit(sample, total)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(values), 4096):
                part = values[at:at + 4096]
                for member, distance in ((True, -1), (False, reach)):
                    index, shard = tree.shards(part, distance)
                    yield pd.DataFrame({"shard": shard, "fp": part[index].view(np.int64), "member": member})

    placed = store(fps.select("fp").mapInPandas(place, "shard bigint, fp bigint, member boolean"), "shards")
    sizes = placed.groupBy("shard").agg(
        F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("queries"))
    own = F.pmod(F.xxhash64("fp"), F.col("own")).cast("int")
    spread = (
        placed.join(sizes, "shard")
        .withColumns({"m": blocks_of("members"), "q": blocks_of("queries")})
        .withColumn("own", F.when(F.col("member"), F.col("m")).otherwise(F.col("q")))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("q")).otherwise(F.col("m")) - 1)))
        .select("shard", F.when(F.col("member"), F.col("own")).otherwise(F.col("other")).alias("m"),
                F.when(F.col("member"), F.col("other")).otherwise(F.col("own")).alias("q"), "fp", "member")
    )

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["fp"].to_numpy(np.int64).view(np.uint64)
        member = frame["member"].to_numpy(bool)
        found = link_block(values[member], values[~member], reach).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return spread.groupBy("shard", "m", "q").applyInPandas(links, "a bigint, b bigint").distinct()


def blocks_of(rows: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK)).cast("int")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): the least node it is connected with.

    Rounds of large-star and small-star: a round only rehangs links, so their number never grows, and a hub's links
    are folded by aggregates and joins on the node.  Each round is written to the shared folder.
    """
    edges = store(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")),
                                                               F.struct(F.col("b").alias("x"), F.col("m").alias("y"))))
                                            .alias("e"))
                 .select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct())
        edges = store(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, words: int, reach: int, key: str) -> DataFrame:
    """``key, fp, component`` for each row of ``docs``: the least key of the component; equal fingerprints are worked once."""
    found = store(fingerprints(docs, words, key), "fingerprints")
    heads = store(found.groupBy("fp").agg(F.min(key).alias("least")), "heads")
    comps = components(near_pairs(heads.select("fp"), reach))
    rooted = heads.join(comps, heads["fp"] == comps["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return found.join(rooted.join(least, "root").select("fp", "component"), "fp")


def simhash_components(docs: DataFrame, words: int = WORDS, reach: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Equal fingerprints are worked once; fingerprints within ``reach`` bits are linked, and a component carries its
    smallest doc_id.  Null texts are empty; texts without words have fingerprint zero and are linked like any other.
    Rows with a null doc_id take part and get their component's smallest id (null only if it has no other).  Repeated
    rows and empty tables pass through; further columns are ignored.
    """
    return grouped(docs, words, reach, "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, reach: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, unchanged, but one of each component: its first document (by doc_id, null last, then by text).

    Rows of one doc_id in different components each stay for theirs; of repeated rows one stays.  Empty tables pass through.
    """
    keyed = packed_rows(docs, F.col("text"), document_key().alias("key"))
    chosen = grouped(keyed.select("key", "text"), words, reach, "key").select(F.col("component").alias("key")).distinct()
    return keyed.join(chosen, "key", "left_semi").dropDuplicates(["key"]).select(*unpacked(docs.columns))
