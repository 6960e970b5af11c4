import zlib

import pytest

from tintloom.llm import sharding

from .fixtures import documents, no_documents


@pytest.mark.parametrize("sample,splitters,exact", [(20_000, 1_000, 500), (40, 8, 5)])
def test_shards_are_even_and_slots_gapless(spark, sample, splitters, exact):
    df = documents(spark).unionByName(documents(spark, n=300, seed=9).selectExpr("cast(7 as bigint) doc_id", "text", *documents(spark).columns[2:]))
    out = sharding.shard(df, n_shards=16, sample=sample, splitters=splitters, exact_rows=exact).collect()
    rows = df.collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == want
    largest, total = max(r["size"] for r in out), sum(r["size"] for r in out)
    held = {}
    for r in out:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 16 and r["grown_shard"] is None
        held.setdefault(r["shard"], []).append(r)
    for own in held.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) <= 2 * largest
    # shards follow the key
    ids = sorted((r["shard"], r["slot"], r["doc_id"]) for r in out if r["doc_id"] is not None)
    spans = {}
    for s, _, i in ids:
        spans.setdefault(s, []).append(i)
    order = [spans[s] for s in sorted(spans)]
    assert all(max(a) <= min(b) for a, b in zip(order, order[1:], strict=False))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    out = sharding.shard(df).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == [(1, 4), (2, 1)]
    assert sharding.shard(no_documents(spark)).count() == 0


@pytest.mark.parametrize("size,sample,splitters,exact", [(5_000_000, 20, 8, 5), (100_000_000, 20_000, 1_000, 500)])
def test_one_text_that_outweighs_all_others(spark, size, sample, splitters, exact):
    df = spark.range(700).selectExpr("id doc_id", f"case when id = 333 then repeat('x', {size}) else 'abcd' end text")
    out = sharding.shard(df, sample=sample, splitters=splitters, exact_rows=exact).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out) == [(i, size + 1 if i == 333 else 5) for i in range(700)]
    shards = [r["shard"] for r in sorted(out, key=lambda r: r["doc_id"])]
    assert shards == sorted(shards) and 0 <= shards[0] and shards[-1] < 16
    held = {}
    for r in out:
        held.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
