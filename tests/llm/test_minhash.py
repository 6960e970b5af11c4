import re
from collections import Counter

import numpy as np
import pytest

from tintloom.llm import minhash
from tintloom.llm.common import components

from .fixtures import documents, find_classes, no_documents


def multiset(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for scale in (1, 3, 40):
        element = np.sort(rng.integers(0, 2**48, 60).astype(np.uint64))
        a, b = rng.integers(0, 4 * scale, 60), rng.integers(0, 4 * scale, 60)
        b = np.where(rng.random(60) < 0.7, a, b)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        of = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = minhash.signatures(of, np.r_[element[a > 0], element[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 4096)
        assert abs((s[0] == s[1]).mean() - want) < 5 * (want * (1 - want) / 4096) ** 0.5


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g " * 5, "", "one two", "x y z w v u t s"]
    whole = minhash.signatures(*minhash.multisets(texts), len(texts))
    for i, t in enumerate(texts):
        assert (minhash.signatures(*minhash.multisets([t]), 1)[0] == whole[i]).all()


def test_classes_match_brute_force(spark):
    df = documents(spark)
    rows = df.collect()
    good = [r for r in rows if r["doc_id"] is not None]
    sets = [multiset(r["text"]) for r in good]
    links = [(i, j) for i in range(len(good)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8 or good[i]["doc_id"] == good[j]["doc_id"]]
    low = find_classes(len(good), links)
    smallest = {}
    for i, r in enumerate(good):
        smallest[low[i]] = min(smallest.get(low[i], r["doc_id"]), r["doc_id"])
    want = {r["doc_id"]: smallest[low[i]] for i, r in enumerate(good)}
    out = minhash.classes(df).collect()
    assert len(out) == len(rows) and sum(v != k for k, v in want.items()) >= 5
    for r in out:
        assert r["class_id"] == want.get(r["doc_id"]), r
    kept = minhash.dedup(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(k for k, v in want.items() if k == v)


def test_chains_and_cross_component_candidates(spark):
    # a chain of texts each close to the next only, and its reverse order of ids
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[15 * k : 15 * k + 200]) for k in range(12)]
    df = spark.createDataFrame([(50 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [multiset(t) for t in texts]
    assert similarity(sets[0], sets[1]) >= 0.8 > similarity(sets[0], sets[2])
    assert {r["class_id"] for r in minhash.classes(df).collect()} == {39}


def test_empty(spark):
    assert minhash.classes(no_documents(spark)).count() == 0
    assert minhash.dedup(no_documents(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 7), (-3, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: -3 for i in range(100, 161)}, -3: -3, 5: 5, 7: 5, 9: 5}


def test_null_and_repeated_ids_on_different_texts(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(14)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in texts]
    # texts without an id, and each again with one, with near copies that have ids
    rows = [(None, t) for t in texts[:8]] + [(100 + k, t) for k, t in enumerate(texts[:8])] + [(200 + k, t) for k, t in enumerate(near[:8])]
    # one id on four texts, each with a near copy; another on a text and none; others alone
    rows += [(50, t) for t in texts[8:12]] + [(60 + k, t) for k, t in enumerate(near[8:12])] + [(70, texts[12]), (70, ""), (71, near[12]), (72, "")]
    rows += [(80, texts[13]), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {None: None} | {i: None for k in range(8) for i in (100 + k, 200 + k)} | {i: 50 for i in (50, 60, 61, 62, 63)} | {70: 70, 71: 70, 72: 72, 80: 80}
    out = minhash.classes(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["class_id"] == want[r["doc_id"]], r
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in minhash.dedup(df).collect()))
    assert kept == sorted([(i or 0, t or "") for i, t in rows if i in (None, 50, 70, 72, 80)])


def test_links_that_bands_would_lose_are_refused():
    with pytest.raises(ValueError, match="least"):
        minhash.classes(None, least=0.6)
