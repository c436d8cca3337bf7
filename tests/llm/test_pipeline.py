from collections import Counter

import corpus_pipeline
from test_text_operators import brute_links, frame, unlucky_docs

from kmerspark.llm import language_id, mixing, ngram_join, pii

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "language_id":
            model = language_id.fit(before)
            kept = {r.doc_id for r in language_id.identify(before, model).where("not rejected").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "ngram_jaccard_join":
            assert ngram_join.similar_documents(docs).where("links > 0 or class_id <> doc_id").count() == 0
        if name == "pii_surrogates":
            surrogates = pii.Surrogates()
            assert {r.doc_id: r.text for r in docs.collect()} == {r.doc_id: pii.scrub(r.text, surrogates)[0] for r in before.collect()}
        if name == "source_mixing":
            wanted = {r.doc_id: r.copies for r in mixing.copies(before).collect() if r.copies}
            assert Counter(r.doc_id for r in docs.collect()) == wanted
        if name == "best_fit_packing":
            pieces = Counter()
            for r in docs.collect():
                pieces[r.doc_id] += r.length
            sizes = Counter()
            for r in before.collect():
                sizes[r.doc_id] += len(r.text)
            assert pieces == sizes
    assert len(corpus_pipeline.STAGES) == 5


def test_near_copies_go_whatever_their_lowest_tokens_are(spark):
    rows = unlucky_docs()
    want = [d for d, c, _ in brute_links(rows)[2] if d == c]
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
