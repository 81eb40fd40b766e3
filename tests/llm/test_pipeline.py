import corpus_pipeline
from caselode.llm import quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    clean = {r.doc_id for r in toxicity.classify(kept, labels).collect() if not r.predicted}
    kept = corpus_pipeline.toxicity_classifier(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} == clean
    last = {rows[i]: i for i in sorted(clean)}
    kept = corpus_pipeline.exact_copies(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} == set(last.values())
    ids = sorted(last.values())
    fps = [simhash.fingerprint(rows[i]) for i in ids]
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    single = {ids[r] for r in root}
    kept = corpus_pipeline.near_copies(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} == single and kept.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == single
