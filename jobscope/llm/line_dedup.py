"""Near-duplicate lines: a segment-partition edit join over all distinct lines.

Lines within one edit agree on at least one of two segments at places that their lengths fix: what lies before a
window, or what lies after it.  A line is indexed under what is left when either window is blanked, and a line one
character longer probes with its own cuts for that length.  Keys that many lines share are cut finer (the same rule
with more, narrower windows), and at last into single characters, where lines that agree on all others are within one
edit of each other without further proof.  So no key, however common, makes pairs of all its lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import document_key, packed_rows, store, unpacked

EDITS = 1
#: Shorter lines are compared for equality only.
LEAST_CHARS = 16
#: Windows of each round, and lines up to which the pairs of a key are compared one by one.
ROUNDS, FEW = (EDITS + 1, 16, 256), 32
FINE = ROUNDS[1]
#: Lines (16 bytes each) up to which those with a partner are sent to every executor to fetch their text.
BROADCAST_LINES = 1_000_000


def cuts(line: Column, length: Column, window: Column, windows: int, longer: int) -> Column:
    """Hash of a line without one window, as cut for lines of ``length``; ``longer``: how many characters it has more."""
    start = F.floor(window * length / windows).cast("int")
    end = F.floor((window + 1) * length / windows).cast("int") + longer
    return F.xxhash64(F.lit(windows), window, length, F.substring(line, F.lit(1), start),
                      F.substring(line, end + 1, F.length(line)))


def index_keys(line: Column, windows: int) -> Column:
    """Keys under which a line is found, of its own length and as probed for lines one shorter, as one array."""
    def every(length: Column, longer: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(windows - 1)),
                           lambda w: cuts(line, length, w, windows, longer))

    return F.concat(every(F.length(line), 0), every(F.length(line) - 1, 1))


def common_start(one: Column, two: Column) -> Column:
    """How many characters two texts have in common from their start: what is unknown is halved, so no text is split."""
    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["least"] + s["most"] + 1, 1)
        same = F.substring(one, F.lit(1), middle) == F.substring(two, F.lit(1), middle)
        return F.when(same, F.struct(middle.alias("least"), s["most"].alias("most"))).otherwise(
            F.struct(s["least"].alias("least"), (middle - 1).alias("most")))

    most = F.least(F.length(one), F.length(two))
    start = F.struct(F.lit(0).alias("least"), most.alias("most"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(most))), start, halved, lambda s: s["least"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def differing(one: Column, two: Column) -> Column:
    """``a, b``: what is left of two texts without the start and then the end that they have in common."""
    def without_end(p: Column) -> Column:
        backwards = F.struct(F.reverse(p["a"]).alias("a"), F.reverse(p["b"]).alias("b"))
        end = bound(backwards, lambda r: common_start(r["a"], r["b"]))
        return bound(end, lambda n: F.struct(*[F.substring(p[c], F.lit(1), F.length(p[c]) - n).alias(c) for c in "ab"]))

    return bound(bound(common_start(one, two), lambda start: F.struct(
        F.substring(one, start + 1, F.length(one)).alias("a"), F.substring(two, start + 1, F.length(two)).alias("b"))), without_end)


def automaton(one: Column, two: Column, edits: int) -> Column:
    """Whether two texts (as characters) are within ``edits`` edits, by a bit-parallel automaton on a band of diagonals.

    Bit ``d`` of ``r<e>`` says that the characters of ``two`` so far, ``j`` of them, can be matched with ``e`` edits to
    the first ``j + d - edits`` of ``one``; the band holds ``2 * edits + 1`` diagonals.
    """
    width = 2 * edits + 1
    bits = [F.lit(n).cast("bigint") for n in range(2)]

    def met(x: Column, j: Column) -> Column:
        """The diagonals on which the next characters are the same."""
        same = [F.when(F.get(one, j + (d - edits)) == x, bits[1] * (1 << d)).otherwise(bits[0]) for d in range(width)]
        return reduce(Column.bitwiseOR, same)

    def step(s: Column, mask: Column) -> Column:
        now = [s["r0"].bitwiseAND(mask)]
        for e in range(1, edits + 1):
            fewer = s[f"r{e - 1}"]  # a replaced character, one of ``two`` left out, one of ``one`` left out
            now.append(s[f"r{e}"].bitwiseAND(mask).bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1))
                       .bitwiseOR(F.shiftleft(now[-1], 1)).bitwiseAND((1 << width) - 1))
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(now)])

    start = F.struct(*[(bits[1] * (((1 << (e + 1)) - 1) << edits)).alias(f"r{e}") for e in range(edits + 1)])
    end = F.aggregate(F.transform(two, met), start, step, lambda s: s[f"r{edits}"])
    diagonal = F.size(one) - F.size(two) + edits
    return diagonal.between(0, width - 1) & (F.call_function("shiftright", end, diagonal).bitwiseAND(1) == 1)


def within_edits(one: Column, two: Column, edits: int) -> Column:
    """Whether two texts are within ``edits`` edits; the automaton walks what their common start and end leave."""
    def characters(text: Column) -> Column:
        return F.filter(F.split(text, ""), lambda c: c != "")

    return (F.abs(F.length(one) - F.length(two)) <= edits) & bound(differing(one, two), lambda p: bound(
        F.struct(characters(p["a"]).alias("a"), characters(p["b"]).alias("b")), lambda t: automaton(t["a"], t["b"], edits)))


def within_one_edit(one: str, two: str) -> Column:
    """Whether two texts are within ``EDITS`` edits."""
    return within_edits(F.col(one), F.col(two), EDITS)


def verified(pairs: DataFrame) -> DataFrame:
    """``later``: of each pair (a, b, line_a, line_b, rank_a, rank_b) within one edit, the line that comes later."""
    return pairs.filter(within_one_edit("line_a", "line_b")).select(
        F.when(F.col("rank_a") < F.col("rank_b"), F.col("b")).otherwise(F.col("a")).alias("later"))


def groups_of(keyed: DataFrame) -> DataFrame:
    """Keys with two or more different lines, and how many."""
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > 1)


def single_characters(lines: DataFrame) -> DataFrame:
    """``later``: lines for which an earlier one differs by one character, by one aggregate and one join on exact cuts."""
    at = F.explode(F.sequence(F.lit(1), F.length("line"))).alias("at")
    cut = lines.select("line_id", "rank", F.length("line").alias("n"), "line", at).select(
        "line_id", "rank", "n", "at", F.sha2(F.concat(F.substring(F.col("line"), F.lit(1), F.col("at") - 1), F.lit("\n"),
                                                      F.substring(F.col("line"), F.col("at") + 1, F.col("n"))), 256).alias("rest"),
        F.sha2(F.concat(F.substring(F.col("line"), F.lit(1), F.col("at") - 1),
                        F.substring(F.col("line"), F.col("at") + 1, F.col("n"))), 256).alias("shorter"))
    first = cut.groupBy("rest").agg(F.min("rank").alias("first"))
    replaced = cut.join(first, "rest").filter(F.col("rank") > F.col("first")).select(F.col("line_id").alias("later"))
    short = lines.select(F.col("line_id").alias("short_id"), F.col("rank").alias("short_rank"),
                         F.sha2("line", 256).alias("shorter"))
    dropped = cut.select("line_id", "rank", "shorter").distinct().join(short, "shorter").select(
        F.when(F.col("rank") > F.col("short_rank"), F.col("line_id")).otherwise(F.col("short_id")).alias("later"))
    return replaced.union(dropped)


def later_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``later``: ids of the lines of ``lines`` (line_id, rank, n, keys) that have an earlier one within one edit."""
    keyed = lines.filter(F.col("n") >= LEAST_CHARS).select("line_id", "rank", F.explode("keys").alias("key"))
    groups = store(groups_of(keyed.select("key")), "groups")
    shared = store(keyed.join(groups, "key").select("line_id", "rank").distinct(), "shared")
    wanted = shared.select("line_id", F.col("rank.doc").alias("doc"), "rank")
    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    held = store(docs.select(document_key().alias("doc"), F.split("text", "\n").alias("all"))
                 .join(wanted, "doc").select("line_id", "rank", F.get("all", F.col("rank.pos")).alias("line"))
                 .dropDuplicates(["line_id"]), "held")
    found = []
    for windows in ROUNDS:
        keyed = held.select("line_id", F.explode(index_keys(F.col("line"), windows)).alias("key")).distinct()
        groups = store(groups_of(keyed), "groups")
        few = keyed.join(groups.filter(F.col("lines") <= FEW), "key").select("line_id", "key")
        pairs = few.alias("x").join(few.alias("y"), "key").filter(F.col("x.line_id") < F.col("y.line_id")).select(
            F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b")).distinct()
        if windows < FINE:
            # Half a line says little where many lines share their halves: only pairs that also agree outside one
            # narrow window are worth comparing character by character.
            fine = store(held.select("line_id", index_keys(F.col("line"), FINE).alias("fine")), "fine")
            sides = [fine.select(F.col("line_id").alias(i), F.col("fine").alias(f"fine_{i}")) for i in "ab"]
            pairs = (pairs.join(sides[0], "a").join(sides[1], "b")
                     .filter(F.arrays_overlap("fine_a", "fine_b")).select("a", "b"))
        pairs = store(pairs, "pairs")
        texts = [held.select(F.col("line_id").alias(i), F.col("line").alias(f"line_{i}"), F.col("rank").alias(f"rank_{i}"))
                 for i in "ab"]
        found.append(store(verified(pairs.join(texts[0], "a").join(texts[1], "b")), "later"))
        many = store(keyed.join(groups.filter(F.col("lines") > FEW), "key").select("line_id").distinct(), "many")
        if many.isEmpty():
            break
        held = store(held.join(many, "line_id"), "held")
    else:
        found.append(store(single_characters(held), "later"))
    return reduce(DataFrame.union, found).distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """``doc, kept``: places (from 0) of the lines that stay, for documents that keep any."""
    lines = docs.select(document_key().alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .filter(F.trim("line") != "")
    keys = F.when(F.length("line") >= LEAST_CHARS, index_keys(F.col("line"), ROUNDS[0]))
    # A line is known by a digest of 128 bits; what depends on the line alone is the same in all its rows.
    firsts = store(lines.groupBy(F.unhex(F.md5("line")).alias("line_id")).agg(
        F.min(F.struct("doc", "pos")).alias("rank"), F.max(F.length("line")).alias("n"), F.max(keys).alias("keys")), "lines")
    later = later_lines(docs, firsts)
    stay = firsts.select("line_id", "rank").join(later, firsts["line_id"] == later["later"], "left_anti")
    return stay.groupBy(F.col("rank.doc").alias("doc")).agg(F.array_sort(F.collect_list("rank.pos")).alias("kept"))


def _deduped(docs: DataFrame) -> DataFrame:
    """``row, text`` of each document, with ``left`` (the text that stays), ``n`` lines and ``gone`` of them."""
    kept = store(kept_lines(docs), "kept")
    packed = packed_rows(docs, F.col("text"), document_key().alias("doc"))
    place = F.transform("kept", lambda p, i: F.concat(
        F.repeat(F.lit("0"), p - F.coalesce(F.get("kept", i - 1), F.lit(-1)) - 1), F.lit("1")))
    joined = packed.join(kept, "doc", "left").withColumns({
        "_lines": F.split("text", "\n"), "_stays": F.split(F.array_join(place, ""), "")})
    left = F.filter("_lines", lambda line, i: (F.trim(line) == "") | (F.get("_stays", i) == "1"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("_lines", lambda x: F.trim(x) != ""))).cast("bigint")
    kept_here = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("kept"), F.lit(0))).cast("bigint")
    return joined.select("row", F.array_join(left, "\n").alias("left"), n.alias("n"), (n - kept_here).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed`` (not counting blank lines).

    A line stays where it first occurs (by doc_id, null last, then by place) if no line that first occurs earlier is
    within one edit; lines of fewer than ``LEAST_CHARS`` characters must be equal.  Blank lines stay.  Lines are what
    line feeds divide.  A null text stays null, a text that loses nothing stays as it is; repeated rows (same doc_id
    and text) are one document and keep the same lines.  Empty tables and further columns pass through; columns of
    ``docs`` that are named like the two counts stay, and the counts are left out.
    """
    counts = {"n_lines": F.col("n"), "n_removed": F.col("gone")}
    return _deduped(docs).select(*unpacked(docs.columns, text=F.col("left")),
                                 *[v.alias(k) for k, v in counts.items() if k not in docs.columns])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` after :func:`dedup_lines`, but those that lost all their lines; other columns unchanged."""
    return _deduped(docs).filter("n = 0 or gone < n").select(*unpacked(docs.columns, text=F.col("left")))
