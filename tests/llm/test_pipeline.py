import duckdb

import corpus_pipeline
from jobscope.llm.common import store, table
from jobscope.llm.decontamination import leaks_of_documents
from jobscope.llm.language_id import MIN_MARGIN, identify_languages
from jobscope.llm.queries import ORACLES
from tests.compare import sql_rows
from tests.llm import edge
from tests.llm.test_lines_and_simhash import brute_fingerprint, brute_groups, brute_lines

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stage(spark, docs, SF))
        docs = store(seen[name][1], name)
        seen[name] = (seen[name][0], docs)
        if name != "mix_sources":
            assert docs.columns == COLUMNS

    given, kept = seen["language_id"]
    told = {r.doc_id for r in identify_languages(given).collect() if r.lang_pred != "und" and r.score >= MIN_MARGIN}
    assert {r.doc_id for r in kept.collect()} == told and len(told) > 0.97 * given.count()

    given, kept = seen["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in given.collect()])
    before = {r.doc_id: r.text for r in given.collect()}
    gone = {k for k, t in want.items() if any(x.strip(" ") for x in before[k].split("\n")) and not t.strip(" \n")}
    assert {r.doc_id: r.text for r in kept.collect()} == {k: t for k, t in want.items() if k not in gone}

    given, kept = seen["simhash_dedup"]
    rows = sorted((r.doc_id, r.text) for r in given.collect())
    groups = brute_groups([brute_fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in kept.collect()} == {rows[g][0] for g in set(groups)}

    given, kept = seen["decontaminate"]
    leaks = {r.doc_id for r in leaks_of_documents(given, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in given.collect()} - leaks

    given, mixed = seen["mix_sources"]
    given.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    names, rows = sql_rows(con, ORACLES["op7_mix_sources"])
    assert sorted(rows) == sorted(tuple(r[n] for n in names) for r in mixed.collect())


def test_run_and_edges(spark, tmp_path):
    edge.documents(spark).select(*COLUMNS, "key", "row").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    # The second of two equal texts has no line of its own left, and texts without letters have no language.
    assert {r.doc_id for r in got.collect()} <= {1, 5, None, 8, 10}
    edge.empty(spark).select(*COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
