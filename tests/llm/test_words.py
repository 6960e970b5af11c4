"""Learning of words by the packing's encoder."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tintloom.llm import packing


def test_words_are_parted_at_once_and_encoded_as_the_tokenizer_does(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    code = packing.Words(tokenizers.path(packing.VOCABULARY))
    texts = ["", "Don't we'll 12 3½ x²", "İstanbul ǅ ﬁ é é ΑΣ", "#$% ... 日本語123 　全角", "<|endoftext|> <s> 's", "zero​width a\u0085b", "🙂👍🏽 x", "a\x1cb"]
    calls, parts = [], code.parts
    monkeypatch.setattr(code, "parts", lambda s: calls.append(s) or parts(s))
    got = code.encode_all(texts)
    assert got == [np.array(code.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(calls) == 1 and code.encode_all(texts) == got and len(calls) == 1


@pytest.fixture
def code():
    return packing.Words(pytest.importorskip("public_tokenizers").path(packing.VOCABULARY))


def test_characters_are_of_the_kind_that_the_tokenizer_takes_them_for(code):
    texts = [f"a{chr(c)}b1" for c in (0x558, 0x58B, 0x88F, 0xC5C, 0x208F, 0x209D, 0x1DF1F, 0x33480)]  # newer Unicode has letters here
    texts += [f"{a}{c}'s{b}" for c in "'sS1½ 　.́​é日" for a in ("", "x", "7", ",") for b in ("", "ve", "'ll", "!")]
    assert code.encode_all(texts) == [code.plain(t) for t in texts]


@pytest.mark.parametrize("most", [3, 40, 500_000])
def test_ids_do_not_depend_on_what_is_kept(code, most):
    code.most = most
    rng = random.Random(most)
    chars = [*"'''stmdrevlLsT .,;19½éİΣς", "　", "\t", "\n", "\x85", "\x1c", "́", "日", "🙂", "<|endoftext|>", "</w>"]
    for _ in range(150):
        texts = ["".join(rng.choices(chars, k=rng.choice([0, 1, 3, 12, 40]))) for _ in range(rng.randint(0, 9))]
        assert code.encode_all(texts) == [code.plain(t) for t in texts]
    ids, bounds = code.encode_array(pa.array(["x", "one two", "", "\x1d y", " three "]).slice(1))
    assert [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [code.plain(t) for t in ("one two", "", "\x1d y", "three")]


def test_windows_and_the_end_mark(spark, code):
    texts = [None, "", *("a " * n for n in (3, 4, 5, 7, 8, 9))]
    out = packing.encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    for r in out:
        ids = code.plain(texts[r["doc_id"]] or "") + np.array([packing.END], "<u4").tobytes()
        assert r["doc_tokens"] == len(ids) // 4 and r["crcs"] == [zlib.crc32(ids[i : i + 16]) for i in range(0, len(ids), 16)]
    assert len(out) == len(texts)
