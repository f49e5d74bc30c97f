import corpus_pipeline as P
from tests.llm import brute


def test_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    first = P.toxicity(spark, docs, sf)
    assert first.columns == P.COLUMNS
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert len(labels - kept) <= 0.03 * len(labels)
    second = P.near_dedup(spark, docs, sf)
    assert second.columns == P.COLUMNS and 0.85 * docs.count() < second.count() < docs.count()
    third = P.repeated_passages(spark, docs, sf)
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in third.collect()}
    want = {i: (removed, kept) for i, _, removed, kept in brute.substring_dedup(list(before.items()))}
    assert all(after[i] == t if not want[i][0] else brute.sha(after[i].encode()) == want[i][1] for i, t in before.items())
    fourth = {r.doc_id for r in P.decontamination(spark, docs, sf).select("doc_id").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holding = {r.doc_id for r in docs.collect() if any(t in r.text for t in items)}
    assert holding and not holding & fourth and len(fourth) >= docs.count() - len(holding) - 3
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]


def test_run(spark, small):
    got = P.run(spark, small)
    assert set(P.COLUMNS) < set(got.columns) and got.count() > 0 and got.where("copies < 1 or copies > 3").count() == 0


def test_edge_rows_go_through_every_stage(spark, edge_docs, no_docs, small):
    for docs in (edge_docs.select(*P.COLUMNS), no_docs.select(*P.COLUMNS)):
        for _, stage in P.STAGES:
            assert stage(spark, docs, small).count() <= docs.count()
