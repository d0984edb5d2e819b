"""One query for each operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import table
from jobscope.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from jobscope.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "llm-token-cache"),
                        public_tokenizers.path(TOKENIZER))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.secret_scan import scan_secrets, secret_digests

    return secret_digests(scan_secrets(table(spark, sf_dir, "documents")))


def op6_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.weighted_sampling import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.decontamination import leaks_of_documents

    return leaks_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.disclosure import personal_digests, scan_personal

    return personal_digests(scan_personal(table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobscope.llm.exact_dedup import group_copies

    return group_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_simhash, op4_html_text, op5_secret_scan,
                                op6_weighted_fingerprint, op7_mix_sources, op8_decontaminate, op9_language_id, op10_personal_data,
                                op11_spelling, op12_importance, op13_exact_dedup)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op13_exact_dedup": r"""
with d as (select doc_id, length(coalesce(text, '')) as n_chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal from documents),
w as (select *, row_number() over best as place, first_value(doc_id) over best as keep_id,
             count(*) over (partition by normal) as group_size
      from d window best as (partition by normal order by n_chars desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(normal) as text_sha256 from w""",
    "op7_mix_sources": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as draw from documents),
s as (select source, sum(size)::bigint as size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
      from s),
c as (select *, 2.0 * size as cap, row_number() over (order by 2.0 * size / weight, source nulls last) as k from w),
p as (select k, 2.0 * size / weight as ratio,
             (select sum(size) * 1.5 from s) - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) as left_over,
             sum(weight) over (order by k rows between current row and unbounded following) as weights from c),
l as (select min_by(left_over / weights, k) as level from p where left_over / weights < ratio),
t as (select source, size as source_size, coalesce(least(cap, weight * (select level from l)), cap) as target from c),
f as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as wholes from t)
select doc_id, size::bigint as size, source_size, target,
       (size * (wholes + (coalesce(sum(size) over (partition by d.source order by draw, size
          rows between unbounded preceding and 1 preceding), 0) + size / 2 <= target - wholes * source_size)::int))::bigint as taken
from d join f on d.source is not distinct from f.source""",
}
