"""Personal data: fixed patterns, and terms that disclose what they protect, by information content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import packed_rows, store, unpacked, whole

# The base kinds in order and their patterns.  Each matches as the plain pattern does, leftmost and
# without overlap: what follows a possessive run can't begin inside it, and a run is tried from its beginning (or from
# the end of the match before) only, so that no text takes more than linear time or a deep stack.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: A term is a word of letters, with apostrophes or hyphens inside; those of at least this many letters within so many
#: words of an entity can disclose it.
LETTERS, REACH = 3, 20
JOINERS = "'\u2019\u2010\u2011-"
TERM = rf"^\p{{P}}*+(\p{{L}}++(?:[{JOINERS}]\p{{L}}++)*+)\p{{P}}*+$"
#: Signs set around matches to find the words they begin and end in.
BEGIN, END = "\ue000", "\ue001"
#: Texts in which a term must occur near an entity, and the share of the entity's information it must then carry:
#: from the first share on it is replaced by a general word, from the second on removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Candidate terms (16 bytes each) up to which they are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_TERMS = 1_000_000


def text_key(text: str = "text") -> Column:
    return F.unhex(F.sha2(text, 256))


def located(texts: DataFrame, keys: list[str], kinds: dict[str, Column],
            right: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``keys, kind, start, end, value, near``: matches of each kind's pattern, in code points.

    What lies between matches is cut at the same places, so a match starts after all pieces and matches before it;
    these are summed over rows, whatever the number of matches.  With ``right``, a condition on kind and value, only
    matches for which it holds are given, and ``near`` are the terms among the words around each, else null.
    ``keys`` must tell texts apart; equal rows count once.
    """
    kept = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", p, F.lit(0)).alias("m"))
                     for k, p in kinds.items()])
    found = texts.select(*keys, "text", F.explode(F.filter(kept, lambda x: F.size(x["m"]) > 0)).alias("x"),
                         *[p.alias(f"_{k}") for k, p in kinds.items()])

    def of_kind(column: Callable[[Column], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("x.kind") == k, column(F.col(f"_{k}"))) for k in kinds])

    parts = [of_kind(lambda p: F.split("text", p, -1)).alias("p")]
    if right:
        # Only texts that hold a right match are cut into words.
        plain = F.translate("text", BEGIN + END, "??")
        signed = of_kind(lambda p: F.regexp_replace(plain, p, F.lit(f"{BEGIN}$0{END}")))
        some = F.exists("x.m", lambda v: right(F.col("x.kind"), v))
        parts += [F.when(some, F.split("text", r"\s+")).alias("words"),
                  F.when(some, F.split(signed, r"\s+")).alias("signed")]
    found = found.select(*keys, "x.kind", "x.m", F.struct(*parts).alias("parts"))

    def row(c: Column, m: Column, i: Column) -> Column:
        step = (F.length(F.get(c["p"], i)) + F.length(m)).alias("step")
        if not right:
            return F.struct(m.alias("value"), step, F.lit(None).cast("array<string>").alias("near"))
        holds = right(F.col("kind"), m)
        return F.struct(F.when(holds, m).alias("value"), step, F.when(holds, words_near(c, i)).alias("near"))

    # The single elements name what is used for every match, which would be cut anew each time.
    parts = F.transform(F.array("parts"), lambda c: c if not right else F.struct(
        c["p"].alias("p"), c["words"].alias("words"), words_with(c["signed"], BEGIN).alias("first"),
        words_with(c["signed"], END).alias("last")))
    rows = F.get(F.transform(parts, lambda c: F.transform("m", lambda m, i: row(c, m, i))), 0)
    placed = found.select(*keys, "kind", F.posexplode(rows).alias("nth", "r")).select(*keys, "kind", "nth", "r.*")
    placed = placed.dropDuplicates([*keys, "kind", "nth"])
    up_to = Window.partitionBy(*keys, "kind").orderBy("nth")
    return placed.withColumn("end", F.sum("step").over(up_to)).filter(F.col("value").isNotNull()).select(
        *keys, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "near")


def words_with(signed: Column, sign: str) -> Column:
    """The place of the word in which each ``sign`` stands, in order of the signs."""
    return F.flatten(F.transform(signed, lambda w, i: F.array_repeat(i, F.length(w) - F.length(F.translate(w, sign, "")))))


def words_near(c: Column, i: Column) -> Column:
    """Terms, in lower case, among the ``REACH`` words before and after match ``i`` and what its own word holds beside it."""
    first = F.get(c["first"], i)
    words = F.concat(
        F.slice(c["words"], F.greatest(first - REACH, F.lit(0)) + 1, F.least(first, F.lit(REACH))),
        F.array(F.element_at(F.split(F.get(c["p"], i), r"\s"), -1), F.get(F.split(F.get(c["p"], i + 1), r"\s", 2), 0)),
        F.slice(c["words"], F.get(c["last"], i) + 2, F.lit(REACH)))
    terms = F.transform(words, lambda w: F.lower(F.regexp_extract(w, TERM, 1)))
    return F.array_distinct(F.filter(terms, lambda w: F.length(F.translate(w, JOINERS, "")) >= LETTERS))


def base_spans(texts: DataFrame) -> DataFrame:
    """``digest, kind, start, end, value, entity, near`` of the base patterns in ``texts`` (digest, text)."""
    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[^0-9]", "")

    def right(kind: Column, value: Column) -> Column:
        count = F.length(digits(value))
        return ((kind == "email")
                | ((kind == "ip") & value.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"))
                | ((kind == "card") & count.between(14, 19) & F.call_function("luhn_check", digits(value)))
                | ((kind == "phone") & count.between(10, 15)))

    value = F.when(F.col("kind").isin("card", "phone"), digits(F.col("value"))).otherwise(F.lower("value"))
    return located(texts, ["digest"], {k: F.lit(p) for k, p in PATTERNS.items()}, right).select(
        "digest", "kind", "start", "end", "value", F.xxhash64("kind", value).alias("entity"), "near")


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``digest, term`` for each row of ``texts`` and each of ``terms`` (h, term) that it holds, once a row."""
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    joined = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<!\p{{L}})\p{{L}}++(?:[{JOINERS}]\p{{L}}++)++"), F.lit(0))
    words = F.transform(F.array_distinct(F.concat(F.split(F.lower("text"), r"[^\p{L}]+"), joined)), lambda w: F.xxhash64(w))
    return texts.select("digest", F.explode(words).alias("h")).join(terms, "h").select("digest", "term")


def disclosing_terms(texts: DataFrame, base: DataFrame) -> DataFrame:
    """``h, term, share``: terms that reveal an entity.

    ``share`` is the pointwise mutual information of term and entity over the entity's information content, the
    greatest of all entities, counted over all documents.  That a term stands near an entity must be seen in
    ``SUPPORT`` different texts; copies of one text don't add to that.
    """
    copies = store(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "copies")
    counted = store(base.select("digest", "entity", "near").join(copies, "digest"), "counted")
    near = counted.select("digest", "copies", "entity", F.explode("near").alias("term")).distinct()
    together = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both"))
    together = store(together.filter(F.col("texts") >= SUPPORT).drop("texts").withColumn("h", F.xxhash64("term")), "together")
    alone = counted.select("digest", "copies", "entity").distinct().groupBy("entity").agg(F.sum("copies").alias("entities"))
    total = F.lit(float(copies.agg(F.sum("copies")).first()[0] or 1))
    spread = occurrences(texts, together.select("h", "term").distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    content = F.log2(total / F.col("entities"))
    shared = F.log2(total * F.col("both") / (F.col("entities") * F.col("held")))
    return store(together.join(alone, "entity").join(spread, "term").filter(content > 0)
                 .groupBy("h", "term").agg(F.max(shared / content).alias("share"))
                 .filter(F.col("share") >= GENERALISE), "terms")


def scan_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest, base, terms`` for each row of ``docs``: arrays of (start, kind, end, value) by start and kind.

    Equal texts are worked once.  Base spans come from the patterns.  A term is added as ``term`` (replaced by a
    general word) or ``drop`` (removed) wherever it occurs, if over the whole corpus it carries at least the given
    share of the information of an entity near which it stands in ``SUPPORT`` or more different texts.

    Null texts are empty; null keys, repeated rows and empty tables pass through; further columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), whole(text).alias("text"))
    texts = rows.select(text_key().alias("digest"), "text")
    base = store(base_spans(texts), "base-spans")
    terms = disclosing_terms(texts, base)
    own = store(occurrences(texts, terms.select("h", "term")).groupBy("digest").agg(
        F.array_sort(F.collect_set("term")).alias("own")), "own-terms")
    # A match must end where its letters end; joined words, which must be whole, come before words that they begin with.
    joined = F.filter("own", lambda w: w.rlike(f"[{JOINERS}]"))
    alone = F.filter("own", lambda w: ~w.rlike(f"[{JOINERS}]"))
    joined = F.transform(joined, lambda w: F.concat(F.lit(rf"(?<!\p{{L}}[{JOINERS}])"), w, F.lit(rf"(?![{JOINERS}]\p{{L}})")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.concat(joined, alone), "|"),
                       F.lit(r")(?!\p{L})"))
    marked = located(texts.join(own, "digest").withColumn("pattern", pattern), ["digest"], {"term": F.col("pattern")})
    marked = marked.join(terms.select(F.col("term").alias("_term"), "share"), F.lower("value") == F.col("_term"), "left") \
        .withColumn("kind", F.when(F.col("share") >= REMOVE, F.lit("drop")).otherwise(F.lit("term")))
    listed = {k: i for i, k in enumerate((*KINDS, "term", "drop"))}
    order = F.element_at(F.create_map(*[F.lit(x) for pair in listed.items() for x in pair]), F.col("kind"))
    span = F.struct("start", order.alias("nth"), "kind", "end", "value")
    spans = base.select("digest", span.alias("s"), F.lit(True).alias("of_base")) \
        .union(marked.select("digest", span.alias("s"), F.lit(False)))
    gathered = store(spans.groupBy("digest").agg(
        F.array_sort(F.collect_list(F.when(F.col("of_base"), F.col("s")))).alias("base"),
        F.array_sort(F.collect_list(F.when(~F.col("of_base"), F.col("s")))).alias("terms")), "spans")
    return rows.select(F.col("key").alias(key), text_key().alias("digest")).join(gathered, "digest", "left") \
        .select(key, "digest", *[F.coalesce(c, F.array().cast(gathered.schema[c].dataType)).alias(c)
                                 for c in ("base", "terms")])


def personal_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans that :func:`scan_personal` found."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(key, *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def sanitise(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with spans replaced in ``text``: ``[email]`` and the like, ``[term]`` for general words, ``drop`` by nothing.

    ``found`` is what :func:`scan_personal` gave for ``docs``.  Spans that begin inside the one before are left to it.
    """
    spans = found.select(F.col("digest").alias("_digest"), F.array_sort(F.concat("base", "terms")).alias("_spans")) \
        .filter(F.size("_spans") > 0).dropDuplicates(["_digest"])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate("_spans", start, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.array(
            F.substring(F.col("_text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
            F.when(s["kind"] == "drop", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))).alias("out"))))
    rows = packed_rows(docs, whole(text).alias("_text")).withColumn("_digest", text_key("_text")).join(spans, "_digest", "left")
    clean = F.concat(F.array_join(F.col("_walked.out"), ""), F.substring(F.col("_text"), (F.col("_walked.at") + 1).cast("int"), F.length("_text")))
    own = F.when(F.col("_spans").isNull(), F.col("row").getField(text)).otherwise(clean)
    return rows.withColumn("_walked", walked).select(*unpacked(docs.columns, **{text: own}))
