"""Awkward documents: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row string, digest string, "
          "fp long, size long, doc string, line string, kept string, h string, target string, _key string, _text string, "
          "_digest string, _spans string, _walked string, left string, gone string, n string, component string")
TAIL = ("k", "r", "d", 1, 2, "o", "l", "p", "h", "t", "K", "T", "D", "S", "W", "L", "G", "N", "C")


def rows():
    long = " ".join(f"word{i % 977} und der" for i in range(30_000))
    texts = [(1, "the cat sat on the mat and then the cat ran away", "en", "a"), (2, None, None, None), (3, "", "de", "b"),
             (4, " \n\t ", None, "a"), (5, long, "de", "b"), (None, "no key here at all", "en", None),
             (7, "the cat sat on the mat and then the cat ran away", "en", "a"), (8, "😀 日本 語", None, "é"),
             (9, "12 34 !!", "en", "a"), (9, "12 34 !!", "en", "a"), (10, "x", "xx", "b")]
    return [(i, t, lang, s, None, *TAIL) for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    """Rows without the order of columns or rows."""
    return sorted(map(str, df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).collect()))
