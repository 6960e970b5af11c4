"""Byte-level BPE against tiktoken, and packing against the tokenizer."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from tintloom.llm import bpe, packing

from .fixtures import documents, no_documents

P = pytest.importorskip("public_tokenizers")


def test_ids_are_those_of_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = documents(spark).unionByName(spark.createDataFrame([(2000, "aaaa" * 300 + " ▁x\u0000 　 日本語 👩‍👩‍👧 don't  \r\n\t <|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True)
    want = {}
    for r in df.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.setdefault(r["doc_id"], set()).add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    out = bpe.encode_decode(df, keep_ids=True).collect()
    assert len(out) == df.count()
    for r in out:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in want[r["doc_id"]], r["doc_id"]
        assert len(r["ids"]) == r["n_tokens"]
    assert bpe.encode_decode(no_documents(spark)).count() == 0


def test_the_model_is_made_from_the_vocabulary_alone():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    code = bpe.Coder(ranks, P.PATTERN)
    assert code.encode("abcab") == "257 256" and code.decode(code.encode("abé \n")) == "abé \n".encode()
    with pytest.raises(ValueError):
        bpe.Coder({b"a": 0}, P.PATTERN)


def check_packing(df, rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    ids = {}
    for r in df.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"], []).append([*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END])
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        want = []
        for x in ids[doc]:
            for i in range(0, len(x), capacity):
                cut = x[i : i + capacity]
                want.append((i, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), len(x)))
        assert sorted(own) == sorted(want)
    return sum(len(x) for v in ids.values() for x in v), len(sequences)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_places_every_id_once(spark, capacity):
    df = documents(spark)
    rows = packing.pack(df, capacity=capacity).collect()
    tokens, sequences = check_packing(df, rows, capacity)
    assert sequences <= tokens / capacity * 1.03 + 1


def test_best_fill_is_the_best():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 5)}
        room = int(rng.integers(1, 90))
        reach = {0}
        for k, n in counts.items():
            reach = {r + k * t for r in reach for t in range(n + 1) if r + k * t <= room}
        used = packing.best_fill(counts, room)
        assert sum(k * n for k, n in used.items()) == max(reach) and all(n <= counts[k] for k, n in used.items())


def test_packing_nothing(spark):
    assert packing.pack(no_documents(spark)).count() == 0


def test_words_encode_as_the_tokenizer_does():
    words = packing.words(P.path(packing.VOCABULARY))
    for text in ("Don't STOP we'll x.y,z!! 42nd", "ÉCOLE Straße ΣΑΣ İstanbul éà", "a\x1cb\x85c d　e", "日本語 テキスト 👍🏽", "<|endoftext|> x", "'s 're''d", "", "Ⅻ ½ ²x _a_"):
        assert words.encode(text) == words.plain(text), text
