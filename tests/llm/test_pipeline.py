import corpus_pipeline
from textgate.llm import bagminhash, grace_dedup, quality


def stages(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        seen.append((name, docs))
    return seen


def test_stages_on_small_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = dict(stages(spark, sf))
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        assert seen[name].columns == docs.columns
    good = {r.doc_id: r for r in seen["quality"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not [i for i, y in labels.items() if y == 1 and i not in good]
    exact = {r.doc_id: r for r in seen["exact_dedup"].collect()}
    contents = {grace_dedup.normalised(r.text) for r in good.values()}
    assert len(exact) == len(contents) == len({grace_dedup.normalised(r.text) for r in exact.values()})
    near = {r.doc_id: bagminhash.shingles(r.text) for r in seen["near_dedup"].collect()}
    assert set(near) <= set(exact)
    for i in near:
        for j in near:
            assert i == j or bagminhash.similarity(near[i], near[j]) < 0.8
    for i in set(exact) - set(near):
        x = bagminhash.shingles(exact[i].text)
        assert any(bagminhash.similarity(x, bagminhash.shingles(r.text)) >= 0.8 for k, r in exact.items() if k != i)
    assert {r.doc_id for r in seen["mixing"].collect()} == set(near)
    assert {r.doc_id for r in seen["packing"].collect()} == set(near)


def test_odd_and_empty_tables(spark, folder, bare_folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, bare_folder).collect() == []
    assert quality.NAMES
