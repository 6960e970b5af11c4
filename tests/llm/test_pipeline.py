import corpus_pipeline

from tintloom.llm import queries

from .fixtures import documents
from .test_toxicity import labelled


def test_stages(spark, tmp_path):
    docs, labels, truth = labelled(spark, 300)
    mine = documents(spark).selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars")
    every = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars").unionByName(mine)
    folder = str(tmp_path / "sf")
    every.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    kept = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        assert after.columns == before.columns, name
        after.write.parquet(f"{folder}/{name}.parquet")
        after = spark.read.parquet(f"{folder}/{name}.parquet")
        left, right = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (kept, after))
        assert right <= left
        if name == "toxicity":
            gone = left - right
            assert sum(truth.get(i, 0) for i in gone) > 0.8 * sum(truth.values())
            assert sum(truth.get(i, 0) == 0 for i in gone) < 0.1 * len(left)
        kept = after
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "packing"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
