import math
import random

import numpy as np
import pytest

from tintloom.llm import ann, semdedup

from .fixtures import find_classes

S = "vec_id long, embedding array<float>, label int, unit string, cell int"


def rows_of(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.05, 0.3, 0.8])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), "u", 0))
    rows[10] = (10, rows[9][1], rows[9][2], None, None)
    rows[11] = (11, [2 * x for x in rows[9][1]], rows[9][2], None, None)
    bad = [None, [], [0.0] * dim, [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(1000 + i, e, 1, None, None) for i, e in enumerate(bad)]
    rows += [(1010, rows[5][1], None, None, None), (1011, [1.0, 2.0], 1, None, None), (1012, [1.0, 2.0], 1, None, None), (None, rows[5][1], 1, None, None), rows[20]]
    return rows


def sound(e):
    return e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


@pytest.mark.parametrize("block,cell_size", [(2048, 500), (16, 20)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block, cell_size):
    monkeypatch.setattr(semdedup, "BLOCK", block)
    rows = rows_of()
    df = spark.createDataFrame(rows, S)
    good = [r for r in rows if r[0] is not None and r[2] is not None and sound(r[1])]
    n, links = len(good), []
    for i in range(n):
        for j in range(i):
            if good[i][2] == good[j][2] and len(good[i][1]) == len(good[j][1]) and cosine(good[i][1], good[j][1]) >= 0.93:
                links.append((i, j))
    assert len(links) > 50
    order = sorted(range(n), key=lambda i: good[i][0])
    place = {k: p for p, k in enumerate(order)}
    low = find_classes(n, [(place[a], place[b]) for a, b in links])
    count = [sum(k in l for l in links) for k in range(n)]
    want = {good[k][0]: (count[k], good[order[low[place[k]]]][0]) for k in range(n)}
    out = semdedup.near_duplicates(df, cell_size=cell_size).collect()
    assert len(out) == len(rows)
    for r in out:
        links_, component = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"], r["kept"]) == (links_, component, r["vec_id"] == component), r


def test_nearest_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 64)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rows = rows_of(n=400)
    df = spark.createDataFrame(rows, S)
    out = ann.nearest(df, df.where("vec_id % 10 = 0")).collect()
    good = [r for r in rows if r[0] is not None and sound(r[1])]
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    queries = {r[0]: r[1] for r in good if r[0] % 10 == 0}
    assert set(got) == set(queries)
    for q, e in queries.items():
        score = sorted(((-cosine(e, x[1]), x[0]) for x in good if x[0] != q and len(x[1]) == len(e)))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
        hits += len({v for _, v in score} & {v for _, v, _ in own})
        total += len(score)
        for _, v, s in own:
            assert abs(s - next(cosine(e, x[1]) for x in good if x[0] == v)) < 1e-9
    assert hits / total >= 0.9


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 96))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn, centre = ann.rotation(96), x.mean(0)
    coded = ann.encode(x, centre, turn)
    for q in x[:20]:
        about, error = ann.estimate(*coded, float(q @ centre), q @ turn, 3.0)
        assert (np.abs(about - x @ q) <= error + 1e-9).mean() > 0.99


def test_empty(spark):
    df = spark.createDataFrame([], S)
    assert semdedup.near_duplicates(df).count() == 0
    assert ann.nearest(df, df).count() == 0
    random.seed(0)
