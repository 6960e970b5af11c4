"""Sharding by sampled splitters.

Records are ordered by a key. A sample weighted by size gives splitters at its quantiles; the exact bytes of the
ranges between them tell where each shard should end, and a range that holds such an end, being overfull for a
shard, is subdivided by new splitters until the end is known to the record. The law is `bytes`: shards hold
nearly equal bytes (they differ by about one record).

Ties in the key are ordered by a hash of the text and then by a hash of the row's place, so a key that holds many
rows, or rows that repeat, are subdivided as well. A null key comes first, a null text has size 1. With fewer rows
than shards some shards are empty. A text as large as several shards fills one, and those beside it may be empty. An
empty table gives an empty result. Only the key and the text are read, whatever other columns are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, id_of, materialize, table

KEY = ["key", "tie", "salt"]
#: Slots are numbered in groups of about so many rows.
RANKED = 500


def _with_range(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Adds `range`: how many of the sorted splitters are at or before the row. Splitters are bounded by a parameter."""
    cuts = [np.array([s[i] for s in splitters], np.int64) for i in range(3)]
    names = rows.columns

    def run(batches):
        for batch in batches:
            own = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in KEY]
            n = len(cuts[0])
            mine = np.r_[np.zeros(n, np.int8), np.ones(batch.num_rows, np.int8)]
            order = np.lexsort((mine, *(np.r_[c, o] for c, o in zip(cuts[::-1], own[::-1], strict=True))))
            passed = np.empty(len(order), np.int64)
            passed[order] = np.cumsum(order < n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed[n:].astype(np.int32))], names=[*names, "range"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", range int")


def _sample(rows: DataFrame, most: int, step: int, total: int, weight: Column) -> list[tuple]:
    """At most `most` keys, each row's chance being in proportion to its weight (the smallest exponential marks).

    total: the sum of the weights. Each step draws anew.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("salt", F.lit(7 + step)), 11) + 0.5) / float(2**53)
    marked = rows.select(*KEY, (-F.log(uniform) / weight).alias("mark"))
    # about 1.5 * most rows have marks below this, so no more than that are sorted, however many tasks there are
    below = marked.where(F.col("mark") <= 1.5 * most / max(total, 1))
    return sorted(tuple(r) for r in below.orderBy("mark").limit(most).select(*KEY).collect())


def _behind(key: tuple) -> tuple:
    """The next key in the order."""
    key = list(key)
    for i in (2, 1, 0):
        if key[i] < 2**63 - 1:
            key[i] += 1
            break
        key[i] = -(2**63)
    return tuple(key)


def boundaries(rows: DataFrame, n_shards: int, sample: int, splitters: int, exact_rows: int) -> list[tuple]:
    """The first key of each shard but the first. The driver holds at most 2 * `sample` keys, 4 * `splitters` sums and
    `exact_rows` keys a boundary.

    Half of the splitters are drawn by size and half by row, and each range also ends just behind a splitter drawn by
    size: so a row that outweighs all others is soon alone in its range, and the rows beside it are subdivided.
    """
    total = rows.agg(F.sum("size")).first()[0]
    found: dict[int, tuple] = {}
    key = F.struct(*KEY)
    literal = lambda s: F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(KEY, s, strict=True)))

    def within(low, high):
        part = key >= literal(low) if low else F.lit(True)
        return part & (key < literal(high)) if high else part

    # stretches of the key order that hold boundaries still to be found: (low, high, bytes before, boundaries)
    open_: list[tuple] = [(None, None, 0, {i: total * i / n_shards for i in range(1, n_shards)})] if total else []
    step = 0
    while open_:
        inside = F.lit(False)
        for low, high, _, _ in open_:
            inside = inside | within(low, high)
        some = rows.where(inside)
        n, held = some.agg(F.count("*"), F.sum("size")).first()
        drawn = []
        for weight, sum_ in ((F.col("size"), held), (F.lit(1), n)):
            taken = _sample(some, sample, step, sum_, weight)
            drawn.append(taken[max(1, len(taken) // splitters) // 2 :: max(1, len(taken) // splitters)])
        cuts = sorted({*drawn[0], *map(_behind, drawn[0]), *drawn[1], *(s for x in open_ for s in x[:2] if s)})
        sums = {r["range"]: r for r in _with_range(some, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        edges = [None, *cuts, None]
        after: list[tuple] = []
        for low, high, before, ends in open_:
            done = before
            for r in range(edges.index(low) if low else 0, edges.index(high, 1) if high else len(edges) - 1):
                if r not in sums:
                    continue
                held = sums[r]["bytes"]
                here = {i: e for i, e in ends.items() if done <= e < done + held}
                if here and sums[r]["n"] <= exact_rows:
                    at = done
                    for k in sorted((tuple(x[n] for n in KEY), x["size"]) for x in rows.where(within(edges[r], edges[r + 1])).collect()):
                        for i, e in here.items():
                            if i not in found and e - at <= k[1] / 2:
                                found[i] = k[0]
                        at += k[1]
                    for i in here:
                        if i not in found:
                            found[i] = edges[r + 1] or (2**63 - 1,) * 3
                elif here:
                    after.append((edges[r], edges[r + 1], done, here))
                done += held
        open_ = after
        step += 1
    return [found[i] for i in sorted(found)]


def shard(docs: DataFrame, *, n_shards: int = 16, key: str = "doc_id", text: str = "text", sample: int = 20_000, splitters: int = 1_000, exact_rows: int = 500) -> DataFrame:
    """Rows (key column, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs."""
    content = F.col(text).cast("string")
    rows = docs.select(
        id_of(key).alias("id"),
        F.coalesce(id_of(key), F.lit(NO_ID)).alias("key"),
        F.xxhash64(content).alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows, "sizes")
    cuts = boundaries(rows.select(*KEY, "size"), n_shards, sample, splitters, exact_rows)
    order = F.struct(*KEY)
    at = F.lit(0)
    for cut in cuts:  # n_shards - 1 literals
        at = at + (order >= F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(KEY, cut, strict=True)))).cast("int")
    parts = max(1, round(rows.count() / n_shards / RANKED))
    dealt = rows.withColumn("shard", at).withColumn("part", F.pmod("salt", F.lit(parts)))
    counts = dealt.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*KEY))
    return dealt.withColumn("inner", inner).join(bases, ["shard", "part"]).select(
        F.col("id").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("inner") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sampled_splitters(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
