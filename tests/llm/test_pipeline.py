import duckdb

import corpus_pipeline
from sparkcorr.llm import decontaminate, pii, quality_rules, registry, simhash
from sparkcorr.llm.common import stash


def test_stages_agree_with_their_operators(spark, sf_dir, documents):
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = documents
    (_, quality), (_, near), (_, clean), (_, private), (_, pack) = corpus_pipeline.STAGES
    out = stash(quality(spark, docs, sf_dir))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    docs, out = out, stash(near(spark, out, sf_dir))
    assert {r.doc_id for r in out.collect()} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
    docs, out = out, stash(clean(spark, out, sf_dir))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in decontaminate.contamination(docs, benchmark).where("not contaminated").collect()}
    docs, out = out, stash(private(spark, out, sf_dir))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == pii.masked(texts[r.doc_id]) and r.n_chars == len(r.text) for r in out.collect()) and out.count() == docs.count()
    assert pack(spark, out, sf_dir).select("doc_id").distinct().count() == out.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > out.count()


def test_empty_and_odd_documents_pass_through(spark, sf_dir, odd_docs, no_docs):
    for docs in (no_docs, odd_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == odd_docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_fixity_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    cursor = con.execute(registry.OP2_SQL)
    names = [x[0] for x in cursor.description]
    got = sorted((tuple(r) for r in registry.op2_fixity(spark, sf_dir).select(*names).collect()), key=repr)
    assert got == sorted(cursor.fetchall(), key=repr)


def test_memory_freed_in_a_task_goes_back():
    """Of many small arrays the last one stays, and with it, but for ``rest``, the heap below it."""
    import gc

    from sparkcorr.llm.common import rest

    mb = lambda: int(open("/proc/self/statm").read().split()[1]) / 256
    held = [bytes([k % 251]) * 9000 for k in range(20_000)]
    last, held = held[-1], held.clear()
    gc.collect()
    before = mb()
    rest()
    assert len(last) == 9000 and mb() <= before - 100
