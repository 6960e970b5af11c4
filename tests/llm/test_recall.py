"""Operator 4 with the bounds it ships, on the largest small table: recall, order and scores against all products."""

import os

import numpy as np
import pytest

from tintloom.llm import queries

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_recall_as_shipped(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {}
    for r in queries.queries()["op4_one_bit_codes"](spark, FOLDER).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        want = sorted(zip(-score, ids, strict=True))[:5]
        own = sorted(found[ids[q]])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in own)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(own, own[1:], strict=False))
        hits, total = hits + len({v for _, v, _ in own} & {v for _, v in want}), total + 5
    assert hits >= 0.95 * total
