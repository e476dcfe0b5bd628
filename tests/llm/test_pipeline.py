import corpus_pipeline
from triptopics.llm import decontaminate, near_dup, pii, quality_rules
from triptopics.session import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage on its predecessor's output, against the operators' own verdicts."""
    docs = table(spark, SF, "documents")
    rows = docs
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == docs.columns
        out.append({r.doc_id: r.text for r in rows.collect()})
    good = {r.doc_id for r in quality_rules.quality_verdicts(docs).collect() if r.kept}
    assert set(out[0]) == good
    first = docs.where(docs.doc_id.isin(list(good)))
    single = {r.doc_id for r in near_dup.near_duplicates(first).collect() if r.kept}
    assert set(out[1]) == single
    leaks = {r.doc_id for r in decontaminate.contaminated(first, table(spark, SF, "benchmark")).collect()}
    assert set(out[2]) == single - leaks and leaks
    assert set(out[3]) == set(out[2])
    for d, text in out[3].items():
        assert not any(pii.base_spans(text).values()) or text != out[2][d]
    changed = [d for d in out[3] if out[3][d] != out[2][d]]
    assert changed


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and all(p.length > 0 and p.offset + p.length <= 1024 for p in pieces)


def test_a_pipeline_of_edge_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.columns[0] == "doc_id"
        assert (rows.count() > 0) == (docs is edge_docs)
