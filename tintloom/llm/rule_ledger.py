"""Quality rules as a ledger of bitmasks.

Each document's measurements and failure bits are computed once, and policies, which name the rules that count and how
many failures are allowed, are applied to the stored bits. What each rule of a policy removes on its own (ablations)
comes from bitwise aggregation of the bits by mask, without another look at the texts.

DataFrame functions only. Texts of at most LONG characters are measured within their row, without a shuffle, by arrays.
Longer ones are exploded into words (in pieces) and measured by grouping and windows, which spill to disk: the same
counts by another plan.

Nulls: a null text has no words, so all its measurements are 0. A null doc_id stays null. Rows that repeat give rows
that repeat. Texts of any length are measured whole. A window of three words needs three words; lines that are alike
but for blanks are different lines. An empty table gives an empty result. Only doc_id and text are read, whatever other
columns there are. Repeated windows are known by 64-bit hashes within their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, table, text_of
from .words import BLANK, let, pieces, times_of, words

LONG = 1_000_000
PIECE = 200_000
#: Fixed value: the characters that count as symbols, as a class of a regular expression.
SYMBOLS = "#*$%&|<>"

#: The rules in the order of their bits; each is the condition of failing, in SQL. A rule never changes its meaning: a
#: new one gets a new bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "some_repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "some_duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Policy:
    """The rules that count, and how many of them a document may fail."""

    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << i for i, name in enumerate(RULES) if name in self.rules)

    def keeps(self, failed: Column) -> Column:
        return F.bit_count(failed.bitwiseAND(self.mask)) <= self.allowed


BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": Policy(BASE),
    "v1": Policy((*BASE, "many_words", "short_words", "long_words", "symbols", "duplicate_lines")),
    "v2": Policy((*BASE, "many_words", "short_words", "long_words", "symbols", "duplicate_lines", "some_repeated_windows", "some_duplicate_lines")),
}
#: The policy in force.
CURRENT = "v1"


def _lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))


def _repeated(w: Column) -> Column:
    """How many words stand in a window of three that is found twice or more."""

    def covered(pairs: Column) -> Column:
        near = lambda k: F.get(pairs, k)["g"]
        twice = F.filter(pairs, lambda p, k: F.coalesce(near(k - 1) == p["g"], F.lit(False)) | F.coalesce(near(k + 1) == p["g"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        # a window covers three words, or those up to the next window
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda held, x: held + x))

    windows = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))


def _in_rows(docs: DataFrame) -> DataFrame:
    text, w = F.col("text"), words(F.col("text"))
    lines = let(_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("different")))
    found = docs.select("*", let(w, lambda x: F.struct(F.size(x).cast("long").alias("n"), _repeated(x).alias("repeated"))).alias("w"), lines.alias("l"))
    return found.select(
        *(c for c in docs.columns if c != "text"),
        F.col("w.n").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
        times_of(text, SYMBOLS).alias("n_symbols"),
        F.col("l.n").alias("n_lines"),
        (F.col("l.n") - F.col("l.different")).alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
    )


def _exploded(docs: DataFrame) -> DataFrame:
    """The same of long texts. Texts are known by doc_id and two hashes; those that repeat are measured once."""
    own = docs.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    once = own.groupBy("h", "g").agg(F.first("text").alias("text"))
    text = F.col("text")
    # where a text is cut at lines, its pieces are the lines themselves
    line = once.select("h", "g", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(f"[^{BLANK}]"))
    lines = line.groupBy("h", "g", F.sha2("line", 256).alias("line")).count().groupBy("h", "g").agg(F.sum("count").alias("n_lines"), F.sum(F.col("count") - 1).alias("n_dup_lines"))
    each = once.select("h", "g", F.posexplode(pieces(text, PIECE)).alias("piece", "part")).select("h", "g", "piece", F.posexplode(words(F.col("part"))).alias("at", "word"))
    order = Window.partitionBy("h", "g").orderBy("piece", "at")
    each = each.select("h", "g", "piece", "at", F.length("word").alias("size"), F.xxhash64("word", F.lead("word", 1).over(order), F.lead("word", 2).over(order)).alias("window"), F.lead("word", 2).over(order).isNotNull().alias("whole"))
    times = F.count(F.when(F.col("whole"), 1)).over(Window.partitionBy("h", "g", "window"))
    each = each.select("h", "g", "piece", "at", "size", (F.col("whole") & (times > 1)).alias("twice"))
    inside = F.max("twice").over(order.rowsBetween(-2, 0))
    counts = each.select("h", "g", "size", inside.alias("inside")).groupBy("h", "g").agg(F.count("*").alias("n_words"), F.sum("size").alias("word_chars"), F.count(F.when(F.col("inside"), 1)).alias("n_repeat_words"))
    symbols = once.select("h", "g", times_of(text, SYMBOLS).alias("n_symbols"))
    out = own.drop("text").join(symbols, ["h", "g"]).join(counts, ["h", "g"], "left").join(lines, ["h", "g"], "left")
    return out.select(*(c for c in docs.columns if c != "text"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES))


def ledger(docs: DataFrame, *, long: int = LONG) -> DataFrame:
    """Rows (doc_id, measurements, failed long): bit i of failed is set where the i-th rule fails."""
    rows = docs.select(id_of().alias("doc_id"), text_of().alias("text"))
    measured = _in_rows(rows.where(F.length("text") <= long)).unionByName(_exploded(rows.where(F.length("text") > long)))
    return measured.withColumn("failed", sum((F.when(F.expr(fails), 1 << i).otherwise(0) for i, fails in enumerate(RULES.values())), F.lit(0)).cast("long"))


def verdicts(held: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """The ledger with a boolean column for each policy, named after it."""
    return held.withColumns({name: policy.keeps(F.col("failed")) for name, policy in (policies or POLICIES).items()})


def ablations(held: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """Rows (policy, rule, n_fail, n_decides, n_kept, n_kept_without): of each rule of each policy.

    n_decides: documents that go, and would stay if this rule alone were left out. The ledger is aggregated by mask;
    all else is done on these few rows. A ledger without rows gives no rows.
    """
    masks = held.groupBy("failed").agg(F.count("*").alias("n"))
    seen = masks.agg(F.bit_or("failed").alias("ever"), F.bit_and("failed").alias("always"))
    out = []
    for version, policy in (policies or POLICIES).items():
        rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << list(RULES).index(name)).cast("long").alias("bit")) for name in policy.rules))
        each = masks.select("n", "failed", F.explode(rules).alias("r"))
        fails, without = F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("failed").bitwiseAND(F.bitwise_not(F.col("r.bit")))
        count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
        kept, kept_without = policy.keeps(F.col("failed")), policy.keeps(without)
        out.append(each.groupBy("r.rule", "r.bit").agg(count(fails, "n_fail"), count(~kept & kept_without, "n_decides"), count(kept, "n_kept"), count(kept_without, "n_kept_without")).withColumn("policy", F.lit(version)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    found = found.join(F.broadcast(seen))  # one row
    is_in = lambda c: F.coalesce(F.col(c).bitwiseAND(F.col("bit")) != 0, F.lit(False)).alias(c)
    return found.select("policy", "rule", "n_fail", "n_decides", "n_kept", "n_kept_without", is_in("ever"), is_in("always"))


def op13_rule_ledger(spark, sf_dir):
    held = verdicts(ledger(table(spark, sf_dir, "documents")))
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base")).alias("base_failed"), F.col(CURRENT).alias("kept"), "n_lines", "failed")
