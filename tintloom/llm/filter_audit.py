"""How quality filters interact: what each of five filters removes in each order in which they can be applied.

A relational word pipeline. Texts are dealt by document once; their words are exploded, counted by (document, word)
and these counts by document, for totals and distincts, without another shuffle. The other flags come from a narrow
pass over the texts and an aggregate by their digest, and are outer-joined with the counts. By part of the corpus, 32
conditional counts then tell how many documents fail exactly each subset of the filters; what every order of the
filters keeps and removes follows from these alone.

The filters (a document fails): A: under 50 words; B: less than 65 % of the words distinct; C: more than 5 % of the
characters in A-Z; D: holds one of #$%&*|; E: its text is that of a document with a smaller doc_id, removed or not.

Nulls: a null text is empty, a null source is the part ''; a null doc_id is smaller than none and none is smaller, so
E keeps it, and it has no label. Rows that repeat are documents of their own; those with the smallest doc_id of a text
all pass E. A document has a label if one of the labels' rows of its doc_id says so. Texts without words pass B and C.
Texts of any length are counted whole, in pieces. An empty table gives an empty result. Only doc_id, text and source
are read, whatever other columns there are. Texts are held equal by their SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, id_of, join_by_key, materialize, table, text_of
from .words import pieces, times_of, words

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Characters of a text whose words are exploded at a time.
PIECE = 200_000


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (key, h, n_words, n_distinct), one for each doc_id and text that has words; h: a hash of the text."""
    texts = docs.select(F.coalesce(id_of(), F.lit(NO_ID)).alias("key"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    once = texts.groupBy("key", "h").agg(F.first("text").alias("text"))  # deals the texts by document
    parts = once.select("key", "h", F.explode(pieces(F.col("text"), PIECE)).alias("piece"))
    each = parts.select("key", "h", F.explode(words(F.col("piece"))).alias("word")).groupBy("key", "h", "word").agg(F.count("*").alias("n"))
    return each.groupBy("key", "h").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): n documents of a part fail the filters whose bits are set in mask (A: 1, E: 16)."""
    text = F.col("text")
    flags = docs.select(id_of().alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of().alias("text")).select(
        "id",
        F.coalesce("id", F.lit(NO_ID)).alias("key"),
        F.xxhash64("text").alias("h"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        "part",
        (100 * times_of(text, "A-Z") > 5 * F.length(text)).alias("c"),
        text.rlike(r"[#$%&*|]").alias("d"),
    )
    flags = materialize(flags.groupBy(*flags.columns).agg(F.count("*").alias("n")), "flags")
    least = flags.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("times")).where("times > 1")
    flags = join_by_key(flags, materialize(least, "copies"), ["digest"], "times", "left")
    # null ids never meet a label, and are dealt by their texts
    known = F.col("id").isNotNull()
    marks = labels.where(id_of().isNotNull()).groupBy(id_of().alias("label_key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.withColumn("known", F.lit(True))
    flags = flags.withColumns({"known": known, "label_key": F.coalesce("id", "h")}).join(marks, ["label_key", "known"], "left")
    both = flags.join(word_counts(docs), ["key", "h"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < 50, 100 * distinct < 65 * n, F.col("c"), F.col("d"), F.coalesce(F.col("least") < F.col("id"), F.lit(False))]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    marked = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return both.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def _bits(letters: Column) -> Column:
    """The mask of some filters' letters."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda held, x: held.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord("A"))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    failed = failures(docs, labels)
    counts = {c: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(SUBSETS))) for c in ("n", "good", "toxic")}
    wide = failed.groupBy("part").agg(*(v.alias(c) for c, v in counts.items()))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    rows = wide.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumns({"before": _bits(F.expr("left(filter_order, step - 1)")), "own": _bits(F.expr("substring(filter_order, step, 1)"))})
    before, own = F.col("before"), F.col("own")
    has = lambda m, bits: m.bitwiseAND(bits) != 0

    def over(column: str, term) -> Column:
        """The sum of a count over the subsets, each times what term gives for it (a condition or a number)."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), F.lit(0).cast("long"), lambda held, m: held + F.get(column, m) * term(m).cast("long"))

    here = lambda m: has(m, own) & ~has(m, before)
    # of the orders of all filters, a filter is the first of those that a document fails in one in so many
    share = lambda m: F.when(has(m, own), F.lit(120) / F.bit_count(m)).otherwise(0)
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: ~has(m, before.bitwiseOR(own))).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda m: has(m, own) & has(m, before)).alias("redundant"),
        over("n", lambda m: m == own).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        over("n", share).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
