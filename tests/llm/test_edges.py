"""Null ids, null texts, repeated rows and columns with clashing names, for the operators that work row by row, chats and shards."""

import pytest

from tintloom.llm import bpe, chat, licenses, packing, sharding

S = "doc_id long, text string, ids string, length int, row int, start string, size string"
ROWS = [(None, "MIT License", "x", 1, 2, "y", "z"), (None, "other words", "x", 1, 2, "y", "z"), (3, None, None, None, None, None, None), (4, "", "x", 0, 0, "", "")]
ROWS += [(5, "the MIT license " * 3, "x", 1, 2, "y", "z")] * 2


@pytest.mark.parametrize("work", [bpe.encode_decode, licenses.scan, packing.pack, sharding.shard])
def test_each_row_has_its_result(spark, work):
    plain = "doc_id long, text string"
    docs = spark.createDataFrame(ROWS, S)
    out = work(docs)
    assert sorted((str(r["doc_id"]) for r in out.collect())) == ["3", "4", "5", "5", "None", "None"]
    again = work(spark.createDataFrame([r[:2] for r in ROWS], plain))
    drop = [c for c in ("sequence_id", "offset", "shard", "slot") if c in out.columns]
    assert sorted(map(str, out.drop(*drop).collect())) == sorted(map(str, again.drop(*drop).collect()))
    assert work(spark.createDataFrame([], S)).count() == 0


def test_chats_with_other_columns_and_long_texts(spark):
    long = "a b " * 500_000
    rows = [(1, 0, "user", long, "x", 1), (1, 1, "assistant", "fine", "y", 2), (None, None, None, None, None, None)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, conv string, part int")).collect()
    text = "".join(r["fragment"] for r in sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["seq"]))
    assert text == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"
    assert len(out) == 3
