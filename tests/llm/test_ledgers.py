"""Operators 11 to 13 against plain Python: nulls, ties, repeated rows, empty tables, clashing columns, long texts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tintloom.llm import filter_audit, prefix_trie, rule_ledger, words

from .fixtures import documents, no_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_pieces_have_the_words_of_the_text(spark):
    rng = random.Random(5)
    texts = ["", " ", "a", "é" * 70, " \n" * 40, "\x0b".join(["word", "x" * 50, "y"] * 9)]
    texts += ["".join(rng.choice("abé \n\t\x85") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for size in (1, 7, 16, 1000):
        got = df.select("text", F.flatten(F.transform(words.pieces(F.col("text"), size), words.words))).collect()
        assert [list(r[1]) for r in got] == [WORDS.findall(r[0]) for r in got]


def audited(docs, labels):
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    mark = {k: {r[0] for r in labels if r[j] == 1 and r[0] is not None} for j, k in ((1, "good"), (2, "toxic"))}
    fails = []
    for i, t, p in rows:
        w = WORDS.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((p, {k for k, v in f.items() if v}, i in mark["good"], i in mark["toxic"]))
    out, first = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for k in range(5):
            x, before = order[k], set(order[:k])
            for part in {p for p, *_ in fails}:
                own = [(f, g, t) for p, f, g, t in fails if p == part]
                here = [(g, t) for f, g, t in own if x in f and not f & before]
                first[part, x] += len(here)
                out[part, order, k + 1] = [sum(not f & (before | {x}) for f, *_ in own), len(here), sum(x in f and bool(f & before) for f, *_ in own), sum(f == {x} for f, *_ in own), sum(g for g, _ in here), sum(t for _, t in here)]
    return {(p, o, k): (*v, first[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit(spark):
    docs = documents(spark)
    more = [(2000 + i, t, None, s, 0, *[None] * 7) for i, (t, s) in enumerate([("THE END $ " * 9, "s"), ("THE END $ " * 9, None), ("a b " * 40, "t"), ("Word# " * 60, "t")])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).cache()
    ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
    marks = [(i, (i or 0) % 2, (i or 0) % 3 == 0 and 1 or None, "x") for i in ids] + [(4, 1, 0, "x"), (5, 0, 1, "x"), (None, 1, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, part string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == audited(docs.collect(), marks)
    assert len(got) == 600 * docs.select(F.coalesce("source", F.lit(""))).distinct().count()


def test_audit_of_nothing_and_of_a_long_text(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_documents(spark), labels).count() == 0
    docs = spark.createDataFrame([(1, "one two " * 200_000, "s"), (2, "x" * 700_000, "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in filter_audit.word_counts(docs).orderBy("key").select("key", "n_words", "n_distinct").collect()] == [(1, 400_000, 2), (2, 1, 1)]


def node_rows(rows):
    """The trie of rows (conv_id, turn, role, text) that have no ties but repeated rows."""
    own = collections.defaultdict(list)
    for c, k, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "")):
        own[c].append((r or "", t or ""))
    built = {c: tuple(own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + s[h:]) for c, s in own.items()}
    node = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            node[s[:d]].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in node if k), collections.Counter(), collections.Counter()
    for k, m in node.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    digest = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == k))).encode()).hexdigest()
    return sorted((min(m), len(k), min(node[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], digest(k, m)) for k, m in node.items())


@pytest.mark.parametrize("block", [3, 50_000])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rng = random.Random(4)
    rows = []
    for c in [*range(40), *range(-7, -1), 1000, 1001]:
        for k in range(rng.randint(1, 12)):
            rows.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""])))
    for c in range(50, 75):  # copies, which keep their first 8 turns alike
        rows += [(c, k, "user", "same") for k in range(9)]
    rows += [(76, None, "user", "before"), (76, 0, None, None), (81, 5, "user", "twice"), (81, 5, "user", "twice"), (None, 0, "user", "nobody"), (90, 0, "u", "x" * 500_000)]
    rows += [(95, k, "user", f"turn {k}") for k in range(60)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, rep string, depth int")
    out = prefix_trie.trie(*prefix_trie.shared_openings(prefix_trie.numbered(df)))
    assert sorted(tuple(-1 if v is None else v for v in r) for r in out.select(*prefix_trie.NODES, "ends_sha256").collect()) == node_rows(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "x")], [(1, 0, "u", "x")]])
def test_small_tries(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = prefix_trie.trie(*prefix_trie.shared_openings(prefix_trie.numbered(df)))
    got = sorted(tuple(-1 if v is None else v for v in r) for r in out.select(*prefix_trie.NODES, "ends_sha256").collect())
    assert got == node_rows(rows)  # the first turn of 1 is one of conversation 0, which isn't there


def measured(text):
    w, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    inside = {i + j for i, x in enumerate(g) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("long", [rule_ledger.LONG, 0])
def test_measurements(spark, monkeypatch, long):
    monkeypatch.setattr(rule_ledger, "PIECE", 50)
    docs = documents(spark)
    texts = ["a b c a b c a b", "x x x x", "# a\n# a\n a\n\n\n# a", "one two", "<|> " * 70, "a b c d " * 30 + "e f", "\n".join(["same line here"] * 9)]
    docs = docs.unionByName(spark.createDataFrame([(3000 + i, t, *[None] * 10) for i, t in enumerate(texts)], docs.schema)).cache()
    got = sorted((str(r["doc_id"]), *(r[c] for c in rule_ledger.MEASURES)) for r in rule_ledger.ledger(docs, long=long).collect())
    assert got == sorted((str(r["doc_id"]), *measured(r["text"] or "")) for r in docs.collect())
    assert rule_ledger.ledger(no_documents(spark), long=long).count() == 0


def test_a_very_long_text(spark):
    text = "alpha beta gamma delta\n" * 100_000 + "w" * 300_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(rule_ledger.ledger(docs).select(*rule_ledger.MEASURES).first()) == (400_001, 2_200_000 - 300_000 + 300_000, 0, 100_001, 99_999, 400_000)


def test_policies_and_ablations(spark):
    rows = [(i, f) for i, f in enumerate([0, 0, 1, 3, 2, 2 + 64, 64, 128, 256 + 32])]
    held = spark.createDataFrame(rows, "doc_id long, failed long")
    policies = rule_ledger.POLICIES | {"lenient": rule_ledger.Policy(("few_words", "repeated_windows"), allowed=1)}
    got = {r["doc_id"]: r for r in rule_ledger.verdicts(held, policies).collect()}
    masks = {k: p.mask for k, p in policies.items()}
    assert masks == {"base": 3, "v1": 127, "v2": 511, "lenient": 3}
    assert all(got[i][k] == (bin(f & m).count("1") <= (k == "lenient")) for i, f in rows for k, m in masks.items())
    found = {(r["policy"], r["rule"]): r for r in rule_ledger.ablations(held, policies).collect()}
    assert set(found) == {(k, rule) for k, p in policies.items() for rule in p.rules}
    for (k, rule), r in found.items():
        bit, allowed = 1 << list(rule_ledger.RULES).index(rule), policies[k].allowed
        keeps = lambda f, m: bin(f & m).count("1") <= allowed  # noqa: B023, E731
        kept, without = [keeps(f, masks[k]) for _, f in rows], [keeps(f, masks[k] & ~bit) for _, f in rows]
        assert (r["n_kept"], r["n_kept_without"], r["n_decides"]) == (sum(kept), sum(without), sum(b > a for a, b in zip(kept, without, strict=True)))
        assert r["n_fail"] == sum(f & bit != 0 for _, f in rows) and r["ever"] == (r["n_fail"] > 0) and not r["always"]
    assert rule_ledger.ablations(held.limit(0)).count() == 0


def test_policies_agree_with_the_labels(spark):
    """On the given table, the policy in force keeps documents of good quality and rejects the others."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = rule_ledger.verdicts(rule_ledger.ledger(docs)).join(labels, "doc_id")
    good, bad = held.where("quality = 1 and base"), held.where("quality = 0")
    assert good.where("not v1").count() <= 0.005 * good.count()
    assert bad.where("v1").count() <= 0.05 * bad.count()
