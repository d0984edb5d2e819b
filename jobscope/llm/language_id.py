"""Language identification by compression."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import rows_of

UNDETERMINED = "und"
#: Bounds of the training sample: languages (the most frequent labels), lines for each, characters of a line, and
#: bytes of a dictionary.  Only the fit is bounded; every text is classified whole.
MAX_LANGUAGES, LINES, LINE_CHARS, DICTIONARY_BYTES = 128, 1500, 1000, 96 * 1024
#: Bytes compressed at a time, so that a long text still leans on the dictionary rather than on itself.
CHUNK = 2048
#: Greedy search for matches of 4 bytes or more: shared word parts count, and it is fast.
LEVEL, MIN_MATCH = 5, 4
#: Relative margin under which a text is compressed again, with each part of the dictionaries in turn: sizes are whole
#: bytes, and the sum over parts tells short and mixed texts apart more finely.
NARROW, PARTS = 0.02, 8
#: Relative margin under which a text counts as undecided in :func:`accept_languages`.
MIN_MARGIN = 0.001


def held_out(key: str = "doc_id") -> Column:
    """Documents never learnt from; those without a key are held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(True))


def letters_of(text: str) -> bytes:
    """What is compressed: the words of a text in lower case between spaces; digits and signs tell no language."""
    import regex

    return (" " + regex.sub(r"[^\p{L}]+", " ", text).strip().lower() + " ").encode()


def fit_languages(labelled: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, bytes]:
    """A dictionary of raw text for each language, from a bounded sample of labelled rows.

    Every label's rows are thinned by a hash of the text to about ``LINES``, and each gives one of its lines; equal
    rows are chosen alike, so reruns agree.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")) \
        .filter(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    share = {r["lang"]: min(1.0, LINES / r["n"]) for r in counts.collect()}
    if not share:
        return {}
    keep = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    lines = F.split("text", "\n")
    picked = (
        rows.filter(F.col("lang").isin(list(share))).filter(chance < keep)
        .select("lang", F.element_at(lines, (F.pmod(F.xxhash64("text", F.lit(1)), F.size(lines)) + 1).cast("int"))
                .alias("line"))
        .select("lang", F.substring("line", 1, LINE_CHARS).alias("line"), F.xxhash64("line").alias("h"))
    )
    samples: dict[str, list[tuple[int, str]]] = {name: [] for name in share}
    for r in picked.distinct().toLocalIterator():
        samples[r["lang"]].append((r["h"], r["line"]))
    out = {}
    for name, own in sorted(samples.items()):
        content = b" ".join(letters_of(line) for _, line in sorted(own))[:DICTIONARY_BYTES]
        if len(content) >= 8:
            out[name] = content
    return out


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` and the given columns: the language whose dictionary makes the text smallest.

    ``score`` is the share by which the runner-up is larger, 0 for a tie (which the first name wins).  A text that is
    null or has no letter is ``und`` with score 0, as is every text if there are no dictionaries.  The only inputs are
    the text and the dictionaries.
    """
    schema = f"{docs.select(key).schema.simpleString()[7:-1]}, lang_pred string, score double"
    kind = docs.select(key).limit(0).toArrow().schema.field(0).type
    names = sorted(dictionaries)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard

        letter = regex.compile(r"\p{L}")
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False,
            write_checksum=False, write_dict_id=False)

        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)

        full = [[compressor(dictionaries[n])] for n in names]
        length = [len(dictionaries[n]) // PARTS for n in names]
        parts = [[compressor(dictionaries[n][i * own:(i + 1) * own]) for i in range(PARTS) if own >= 8]
                 or [compressor(dictionaries[n])] * PARTS for n, own in zip(names, length)]

        def decide(chunks: list[bytes], models: list[list[zstandard.ZstdCompressor]]) -> tuple[str, float]:
            sizes = sorted((sum(len(c.compress(x)) for c in own for x in chunks), n) for own, n in zip(models, names))
            best, other = sizes[0], sizes[1] if len(sizes) > 1 else (sum(map(len, chunks)) * len(models[0]), "")
            return best[1], max(0.0, 1 - best[0] / max(other[0], 1))

        def one(value: str | None) -> tuple[str, float]:
            if not value or not names or not letter.search(value):
                return UNDETERMINED, 0.0
            raw = letters_of(value)
            chunks = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
            name, margin = decide(chunks, full)
            return decide(chunks, parts) if margin < NARROW else (name, margin)

        for batch in batches:
            for rows in rows_of(batch, 64):
                found = [one(t) for t in rows["text"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["key"], kind), pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(classify, schema)


def identify_languages(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``, learnt from those of ``labelled`` (or of
    ``docs``) that are not held out.  Null keys and repeated rows pass through; further columns are ignored."""
    source = docs if labelled is None else labelled
    dictionaries = fit_languages(source.filter(~held_out()))
    return (predict_languages(docs, dictionaries)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


def accept_languages(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language can be told: not ``und``, and not within ``min_margin``."""
    dictionaries = fit_languages(docs.filter(~held_out()))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"))
    told = predict_languages(packed, dictionaries, key="row")
    return told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_margin)) \
        .select(*[F.col("row").getField(c).alias(c) for c in columns])
