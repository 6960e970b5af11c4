"""The queries on the smallest tables: with SQL against DuckDB, the classifier and the pipeline's stages against plain recomputation."""

import collections
import glob
import math
import os

import pytest

import corpus_pipeline
from tests.test_queries import rows_of
from tintloom.llm import oracle, queries, toxicity

from .test_toxicity import labelled

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def duck_over(**tables):
    """A connection with views of the smallest tables; tables: folders that take the place of some."""
    c = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(f)[:-8]
        c.execute(f"create view {name} as select * from '{tables[name] + '/*.parquet' if name in tables else f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_equals_sql(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    got = duck_over().execute(oracle.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_has_rows_of_the_whole_table(spark, name):
    rows = queries.queries()[name](spark, FOLDER)
    key = {"op1": "conversations", "op4": "embeddings"}.get(name.split("_")[0], "documents")
    table = spark.read.parquet(f"{FOLDER}/{key}.parquet")
    if key == "embeddings":
        assert rows.count() == 5 * table.where("vec_id % 50 = 0").count()
    elif key == "documents":
        assert rows.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
    else:
        assert rows.count() > 0


def plain_features(text):
    """The places of a text's features, n-gram by n-gram in plain integers."""
    all_ = 2**64 - 1
    s, counts = " " + " ".join(text.lower().replace("\0", " ").split()) + " ", collections.Counter()
    for n in toxicity.SIZES:
        for i in range(len(s) - n + 1):
            v = 0
            for ch in s[i : i + n]:
                v = (v * 0x100000001B3 + ord(ch)) & all_
            v = (v + n + 0x9E3779B97F4A7C15) & all_
            v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & all_
            v = (v ^ v >> 27) * 0x94D049BB133111EB & all_
            counts[(v ^ v >> 31) >> 64 - toxicity.BITS] += 1
    return {bucket + (level << toxicity.BITS) for bucket, n in counts.items() for level, least in enumerate(toxicity.LEVELS) if n >= least}


def test_classifier_is_what_plain_counts_give(spark):
    docs, labels, _ = labelled(spark, 200)
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = {i: plain_features(t) for i, t in texts.items()}
    learnt = {r["doc_id"]: r["toxic"] for r in labels.where(~toxicity.held_out()).collect() if r["doc_id"] in texts}
    seen = [collections.Counter(f for i, y in learnt.items() if y == k for f in own[i]) for k in (0, 1)]
    n0, n1 = (sum(y == k for y in learnt.values()) for k in (0, 1))
    found = {}
    for f in set(seen[0]) | set(seen[1]):
        a, b = seen[0][f], seen[1][f]
        share = (a + b) / (n0 + n1)
        if share < 1 and a + b >= 4:
            z = abs(b - n1 * share) / math.sqrt(n1 * share * (1 - share) + 1e-9)
            if z >= 5.0:
                found[f] = z
    used = set((model.place >= 0).nonzero()[0].tolist())
    assert 0 < len(used) == min(len(found), 8192) and used <= set(found)
    assert min(found[f] for f in used) >= max((z for f, z in found.items() if f not in used), default=0) - 1e-9
    # a feature weighs on the side on which it is more frequent, unless the regression takes it back
    sign = [(seen[1][f] / n1 - seen[0][f] / n0) * model.weight[model.place[f]] for f in used]
    assert sum(x > 0 for x in sign) > 0.8 * len(sign)
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(model.weight[model.place[f]] for f in own[r["doc_id"]] if model.place[f] >= 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_pipeline_stages_are_exact(spark, tmp_path):
    docs, at = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(at[name])
        docs = spark.read.parquet(at[name])
    ids = lambda name: [r[0] for r in spark.read.parquet(at[name]).select("doc_id").orderBy("doc_id").collect()]
    # toxicity: those that the query predicts as clean
    scored = queries.queries()["op7_toxicity"](spark, FOLDER).where("predicted = 0").select("doc_id").orderBy("doc_id").collect()
    assert ids("toxicity") == [r[0] for r in scored]
    # lines: the texts that the SQL of operator 2 leaves of what toxicity kept
    c = duck_over(documents=at["toxicity"])
    gone_or_blank = f"WITH o AS ({oracle.LINE_DEDUP}) SELECT doc_id, kept_sha256, kept_chars FROM o"
    want = {r[0]: r[1:] for r in c.execute(gone_or_blank).fetchall()}
    got = dict(spark.read.parquet(at["line_dedup"]).selectExpr("doc_id", "sha2(coalesce(text, ''), 256)").collect())
    assert got and all(want[i][0] == h for i, h in got.items())
    texts = dict(spark.read.parquet(at["toxicity"]).select("doc_id", "text").collect())
    for i in set(want) - set(got):  # a document goes only if none of its words is left
        assert want[i][1] < len(texts[i])
    # near copies: one of each class that the SQL of operator 6 finds in what was left
    c = duck_over(documents=at["line_dedup"])
    want = [r[0] for r in c.execute(f"WITH RECURSIVE o AS ({oracle.NEAR_COPIES}) SELECT doc_id FROM o WHERE kept ORDER BY doc_id").fetchall()]
    assert ids("minhash") == want
    # packing: each id of each document in one place of one sequence
    pieces = spark.read.parquet(at["packing"]).collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    for key, begin, whole in (("doc_id", "start", True), ("sequence_id", "offset", False)):
        ends = collections.defaultdict(int)
        for r in sorted(pieces, key=lambda r: (r[key], r[begin])):
            assert r[begin] == ends[r[key]]
            ends[r[key]] += r["length"]
        assert all(n == max(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i, n in ends.items()) if whole else max(ends.values()) <= 2048
