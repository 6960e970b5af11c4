"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, size string, key string, part string, score string, kept string"


def vocabulary(n=400, seed=3):
    rng = random.Random(seed)
    parts = ["ba", "ke", "lo", "mi", "ru", "ta", "ve", "zo", "en", "st", "er", "üb", "çe", "ñi"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text_of(rng, words, n, per_line=12):
    out = [rng.choice(words) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + per_line]) + "." for i in range(0, n, per_line))


def documents(spark, n=60, seed=1):
    rng, words = random.Random(seed), vocabulary()
    texts = [text_of(rng, words, rng.randint(1, 160)) for _ in range(n)]
    for i in range(5, n, 7):  # near copies: one word changed
        w = texts[i - 1].split(" ")
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    texts[8], texts[9] = texts[7], texts[7]
    rows = [(i, t, "en", "s", len(t), "r", "h", "z", "k", "p", "x", "y") for i, t in enumerate(texts)]
    long_text = text_of(rng, words, 9000)
    rows += [(1000, None, None, None, None, *[None] * 7), (1001, "", None, None, 0, *[None] * 7), (1002, " \n\t ", None, "s", 4, *[None] * 7), (1003, long_text, "en", "s", len(long_text), *[None] * 7)]
    rows += [(None, "a text without an id", None, None, None, *[None] * 7), rows[3], rows[3], (1004, "one", None, None, 3, *[None] * 7), (1005, "line\x1cwith\x85odd space don't I'LL 42nd  Ⅻ", None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def find_classes(n, links):
    """The smallest index reachable from each of 0..n-1."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low
