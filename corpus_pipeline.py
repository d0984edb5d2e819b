"""From raw documents to a training mix: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import jobscope
from jobscope.llm.common import store, table
from jobscope.llm.decontamination import without_leaks
from jobscope.llm.language_id import accept_languages
from jobscope.llm.line_dedup import without_repeats
from jobscope.llm.mixing import mix_sources
from jobscope.llm.simhash import keep_one_of_each

# The package need not be installed on the workers: its Python functions travel with the tasks.
cloudpickle.register_pickle_by_value(jobscope)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return accept_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred before; those with no line of their own go.  ``n_chars`` stays as given."""
    return without_repeats(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, size, source_size, target, taken``."""
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate), ("mix_sources", mix)]

#: The stages' methods (compression, edit joins, tiling) have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next.

    Empty tables, null columns and repeated rows are handled by each stage as its operator states.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
