"""Texts of any length are worked on part by part: the same results, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest

from tintloom.llm import common, lines, minhash
from tintloom.llm.packing import Words

from .fixtures import text_of, vocabulary


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def texts(seed=4):
    rng, words = random.Random(seed), vocabulary()
    some = [text_of(rng, words, rng.randint(0, 300)) for _ in range(20)]
    return ["", *some, "\n\n a \n", "x" * 700, "\n".join(some), "", "\n".join(some[:5]) + "\n", "\ud800 \u03a3\u03a3 \u03a3", ""]


@pytest.mark.parametrize("most", [3, 50, 400])
def test_words_do_not_depend_on_parts_and_windows(monkeypatch, most):
    want = common.word_hashes(texts())
    whole = [common._byte_word_hashes(t.lower().encode("utf-8", "surrogatepass")) for t in texts()]
    for t, (start, value) in zip(texts(), whole, strict=True):
        got = common._byte_word_hashes(t.lower().encode("utf-8", "surrogatepass"), most)
        assert (got[0] == start).all() and (got[1] == value).all()
    monkeypatch.setattr(common.parts_of, "__defaults__", (most, common._blank))
    got = common.word_hashes(texts())
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("piece", [1, 40, 1000])
def test_lines_do_not_depend_on_parts(monkeypatch, piece):
    def found():
        out = []
        for part, of, number in lines.lines_of(texts(), 0):
            out += zip(of.tolist(), number.tolist(), part.hashes(part.begin, part.end).tolist(), part.size.tolist(), strict=True)
        return out

    want = found()
    assert len(want) == sum(t.count("\n") + 1 for t in texts())
    monkeypatch.setattr(lines, "PIECE", piece)
    assert found() == want


def test_signatures_do_not_depend_on_how_many_points_are_drawn_at_once(monkeypatch):
    of, element, count = minhash.multisets(texts() + ["to be or not to be " * 200])
    want = minhash.signatures(of, element, count, len(texts()) + 1)
    monkeypatch.setattr(minhash, "DRAWN", 37)
    assert (minhash.signatures(of, element, count, len(texts()) + 1) == want).all()


def test_long_texts_take_little_memory():
    rng, words = random.Random(5), vocabulary()
    text = "\n".join(text_of(rng, words, 1200) for _ in range(500))
    assert len(text) > 3_500_000

    def through(most=0):
        for part, _, _ in lines.lines_of([text], 10):
            part.letters(part.chosen)

    assert peak(through) < 12 * len(text)  # 43 bytes a character if taken at once
    assert peak(lambda: minhash.signatures(*minhash.multisets([text]), 1)) < 22 * len(text)  # 36 before


def test_powers_kept_are_bounded():
    n = common.Powers.most_kept + 5
    up, down = common.Powers.get(n)
    assert len(up) == n and (up * down == np.uint64(1)).all()
    assert len(common.Powers.up) <= common.Powers.most_kept


def test_word_cache_is_bounded_in_characters():
    import public_tokenizers

    code = Words(public_tokenizers.path("word_bpe_49k.json"))
    code.most_chars = 5_000
    rng = random.Random(6)
    for _ in range(40):
        stretch = "".join(rng.choice("abcdefgh") for _ in range(1_500))
        assert code.encode(stretch) == code.plain(stretch)
        assert all(sum(map(len, held)) <= 6_500 for held in (code.known, code.older, code.pieces))
