import random

import numpy as np

from tintloom.llm import lines

from .fixtures import documents, find_classes, no_documents


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abxyzé")
        elif kind == 1:
            s.insert(i, rng.choice("abxyzé"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_banded_distance_is_exact_up_to_its_limit():
    rng = random.Random(2)
    for most in (1, 2, 3):
        pairs = []
        for _ in range(300):
            a = "".join(rng.choice("abcd é") for _ in range(rng.randint(12, 60)))
            b = edited(rng, a, rng.randint(0, most + 2))
            if abs(len(a) - len(b)) <= most:
                pairs.append((a, b))
        want = np.minimum([levenshtein(a, b) for a, b in pairs], most + 1)
        assert (lines.edit_distances(pairs, most) == want).all()


def corpus(spark, seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ijklm é") for _ in range(rng.randint(34, 80))).strip().ljust(34, "q") for _ in range(30)]
    rows = []
    for i in range(60):
        own = [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 5))]
        own += [rng.choice(["short", "a line of middle size", "", "  padded line of some length  "])]
        rows.append((i, "\n".join(own)))
    return spark.createDataFrame([*rows, (60, None), (61, ""), rows[3], (None, base[0])], "doc_id long, text string"), rows


def brute(rows, edits=2, least=10, least_near=32):
    occ = [(i, n, s.strip(" \t\n\x0b\x0c\r")) for i, t in rows for n, s in enumerate(t.split("\n"))]
    occ = [o for o in occ if len(o[2]) >= least]
    distinct = sorted({o[2] for o in occ})
    at = {s: k for k, s in enumerate(distinct)}
    links = [(i, j) for i, a in enumerate(distinct) for j in range(i) if len(a) >= least_near and len(b := distinct[j]) >= least_near and abs(len(a) - len(b)) <= edits and levenshtein(a, b) <= edits]
    low = find_classes(len(distinct), links)
    first = {}
    for i, n, s in sorted(occ):
        first.setdefault(low[at[s]], (i, n))
    keep, long = set(first.values()), {(i, n) for i, n, _ in occ}
    return {i: "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in long or (i, n) in keep) for i, t in rows}, len(links)


def test_matches_brute_force(spark, monkeypatch):
    df, rows = corpus(spark)
    want, n = brute([(i, t) for i, t in [(-(2**63), df.where("doc_id is null").first()["text"]), *rows]])
    assert n > 20
    for frequent in (lines.FREQUENT, 1):  # with 1 and every line sampled, all keys are split
        monkeypatch.setattr(lines, "FREQUENT", frequent)
        monkeypatch.setattr(lines, "SAMPLE", 1 if frequent == 1 else 64)
        out = lines.apply_drops(df, lines.drops(df)).collect()
        assert len(out) == df.count()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in out:
            assert r["kept"] == (want[r["doc_id"]] if r["doc_id"] in want else want[-(2**63)] if r["doc_id"] is None else texts[r["doc_id"]])


def test_documents_keep_their_columns(spark):
    df = documents(spark)
    out = lines.dedup(df)
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 1000 in ids and 1001 in ids and 1003 in ids and 8 not in ids and 9 not in ids and ids.count(3) == 3
    assert lines.dedup(no_documents(spark)).count() == 0
    for r in out.where("n_chars is not null and length(text) <> n_chars").collect():
        raise AssertionError(r)


def test_rows_that_share_an_id_or_have_none(spark):
    common = "a first line that all of these texts have"
    for own in (None, 7):
        texts = [f"{common}\n{name * 12}\n{common}" for name in ("alpha", "beta", "gamma", "delta")]
        df = spark.createDataFrame([*((own, t) for t in texts), (own, texts[0]), (9, common)], "doc_id long, text string").repartition(3)
        out = [(r["doc_id"], r["kept"]) for r in lines.apply_drops(df, lines.drops(df)).collect()]
        assert len(out) == 6 and (9, "") in out
        # one text keeps the line, once; its repeated row is the same document
        assert len({kept for _, kept in out if common in kept}) == 1 and all(kept.count(common) <= 1 for _, kept in out)
        # what is not repeated stays
        stay = [n for _, kept in out for n in ("alpha", "beta", "gamma", "delta") if n * 12 in kept.split("\n")]
        assert sorted(stay) == ["alpha", "alpha", "beta", "delta", "gamma"]


def test_trimming_takes_time_in_proportion():
    texts = [" " * 50_000 + "x" + "\t" * 50_000, "   ", "", "  a b \n\n c\x0b"]
    own = lines.Lines(texts, 0)
    raw = "\n".join([*texts, ""])
    got = [raw[b:e] for b, e in zip(own.begin.tolist(), own.end.tolist(), strict=True)]
    assert got == ["x", "", "", "a b", "", "c"]
