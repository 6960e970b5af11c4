import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tintloom.llm import toxicity

from .fixtures import documents, no_documents, text_of, vocabulary


def labelled(spark, n=500, seed=2):
    rng, words = random.Random(seed), vocabulary()
    bad = ["grobian", "schuft", "lump", "fiesling"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = text_of(rng, words, rng.randint(20, 80))
        if toxic:
            parts = text.split(" ")
            for _ in range(rng.randint(2, 5)):
                parts.insert(rng.randrange(len(parts)), rng.choice(bad))
            text = " ".join(parts)
        docs.append((i, text, "en", "s"))
        labels.append((i, 1, int(toxic)))
    extra = [(9000, None, None), (9001, 0, None), (0, 1, labels[0][2]), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 500 and 60 < len(held) < 140
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_labels_of_held_out_rows_are_never_seen(spark):
    docs, labels, _ = labelled(spark, 300)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()) for x in (labels, flipped))
    assert np.allclose([s for _, s in a], [s for _, s in b], atol=1e-9)


def test_edges(spark):
    docs, labels, _ = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    df = documents(spark)
    out = toxicity.score(df, model).collect()
    assert len(out) == df.count() and all(r["score"] == r["score"] for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1000, 1001)}) == 1
    assert toxicity.clean(df, model).columns == df.columns
    assert toxicity.score(no_documents(spark), model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}
    only = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r["predicted"] for r in toxicity.score(docs, only).collect()} == {1}


def test_one_large_document_does_not_cut_off_the_others(spark):
    docs, labels, truth = labelled(spark, 300)
    first = docs.where(~toxicity.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    others = docs.where(F.col("doc_id") != first)
    without = toxicity.fit(others, labels, most_bytes=400_000)
    assert len(without.weight)
    long_text = spark.createDataFrame([(first, "word " * 100_000, "en", "s")], docs.schema)
    repeated = spark.createDataFrame([(first, "word " * 1_000, "en", "s")] * 100, docs.schema)
    for large in (long_text, repeated):
        df = others.unionByName(large)
        model = toxicity.fit(df, labels, most_bytes=400_000)
        assert (model.place == without.place).all() and np.allclose(model.weight, without.weight)
        out = toxicity.score(df, model).collect()
        assert len(out) == df.count() and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out if r["doc_id"] != first]) > 0.93
    # with nothing but large documents, those that fit are still learnt from
    assert len(toxicity.fit(docs, labels, most_bytes=400_000, most_share=0.0).weight)
