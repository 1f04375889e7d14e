import corpus_pipeline
from spendtrace.llm.queries import QUERIES
from tests.llm.test_oddsketch import components
from tests.llm.test_outliers import counts
from tests.llm.test_packing import ids_of

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before
        if stage is corpus_pipeline.quality_rules:
            assert before - after and not any(counts(rows[i])[0] < 50 for i in after)
        if stage is corpus_pipeline.near_dedup:
            groups = components([(i, rows[i]) for i in sorted(before)])
            assert after == {i for i in before if groups[i] == i}
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        good = [i for i in before if labels.get(i) == 1 and counts(rows[i])[0] >= 50]
        if stage is not corpus_pipeline.near_dedup:
            assert sum(i in after for i in good) >= 0.98 * len(good)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == after
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(ids_of(rows[i])) for i in after}


def test_contract_columns(spark):
    want = {
        "op5": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op8": ["vec_id", "n_links", "component_id", "kept"],
    }
    for name, query in QUERIES.items():
        if (op := name.split("_")[0]) in want:
            df = query(spark, SF)
            assert df.columns == want[op] and df.count() > 0


def test_classifier_rejects_bad_documents_among_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    # Held-out documents of label 0: those that stay are labelled alike, so they alone teach nothing.
    bad = {37, 67, 167}
    good = {i for i, y in labels.items() if y == 1}
    assert all(labels[i] == 0 for i in bad)
    some = docs.where(docs.doc_id.isin(*bad, *good))
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, some, sf).collect()}
    assert not bad & kept and len(good & kept) >= 0.98 * len(good)
