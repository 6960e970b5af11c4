"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A shingle with count w stands for the unit levels (0, 1], (1, 2] ... (w-1, w]. Levels are grouped into rungs
(0, 1], (1, 2], (2, 4], (4, 8] ..., each with a Poisson process of a rate of its width; a rung is halved when more of
its points are wanted: one half keeps the first point, the other draws the next one. Points of levels up to w fall
into random registers, and a register keeps its earliest point. Two multisets agree in a register with the
probability of their weighted Jaccard similarity. Halves that begin at w or later, and those whose first point comes
after the latest register, are dropped, so most of the tree is never drawn.

Registers are banded. Candidates are members of a bucket whose one-bit sketches (the registers' lowest bits) are not
far apart; a bucket's rows carry the sketches, so only candidates become rows. They are verified exactly by the overlap of
their multisets. In each round a bucket has a leader, at first the member found in the fullest buckets, later one of
its largest component, and each multiset is verified with one leader only, the nearest by sketch. Rounds go on while
they find links. Then members of each bucket's smaller components meet all others of the bucket, in blocks of bounded
size; a pair becomes a row in the first band on which it agrees. So every candidate pair is verified or already
connected, and a bucket of copies is not paired out.

Candidates are found and verified between multisets, each with its own bands, sketch and text, whatever the ids of
its rows; documents with equal multisets form one class at once. Rows that share a doc_id are taken as one document:
the classes of all its texts join afterwards; null ids count as one id. Nulls count as empty; a text without words is
a class of its own and kept, unless its id has other texts. A text with fewer words than a shingle has one shingle of
all its words. An empty table gives an empty result. Only doc_id and text are read, whatever other columns are named;
``dedup`` passes them on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, components, discard, id_of, join_by_key, materialize, mix, shingle_hashes, slices, small_batches, table, text_of, tidy, wanted, wanted_filter

#: The least similarity that bands and sketches are made for.
LEAST = 0.8
BANDS, WIDTH = 30, 5
REGISTERS = 1024
#: Registers whose lowest bits make the sketch. Texts that differ in more bits than FAR are not candidates: at a
#: similarity of 0.8 about 102 of 1024 bits differ, with a deviation of 9.6.
WORDS, FAR = REGISTERS // 64, 146
#: The last step also compares the registers' second bits: at 0.8 about 154 registers differ in one of both, with a
#: deviation of 11.4.
FAR_BOTH = 206
#: Members of a bucket that share a leader, or meet as a block, in one task.
BLOCK = 1024
#: Texts are worked on by slices of so many characters.
PIECE = 400_000
#: Points of so many distinct shingles are drawn side by side.
DRAWN = 100_000
#: A round of leaders that finds links in fewer of its pairs is the last one.
FEW = 0.1
#: Bits of a shingle's hash that are kept; the rest of 64 bits tells texts apart while sorting.
HASH_BITS = 48


def multisets(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order: index of the text, hash, count."""
    of, value = shingle_hashes(texts, width)
    key = of.astype(np.uint64) << np.uint64(HASH_BITS) | value >> np.uint64(64 - HASH_BITS)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), counts


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _seed(element, low, size, index) -> np.ndarray:
    """Of the index-th point that a range of levels of an element draws."""
    return mix(element * _A + np.asarray(low, np.uint64) * _B + np.asarray(size, np.uint64) * _C + np.asarray(index, np.uint64))


def signatures(of: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers identities (32 bits) of the earliest points; texts without shingles have zeros."""
    time = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint32)

    def emit(doc, seed, at):
        """Point of a seed at a time falls into its register."""
        again = mix(seed ^ _B)
        cell = doc * registers + (_uniform(again) * registers).astype(np.int64)
        np.minimum.at(time, cell, at)
        won = at == time[cell]
        who[cell[won]] = (again[won] & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    for begin in range(0, len(element), DRAWN):
        part = slice(begin, begin + DRAWN)
        _draw(of[part], element[part], count[part], emit, lambda: time.reshape(n, registers).max(1))
    return who.reshape(n, registers)


def _draw(of: np.ndarray, element: np.ndarray, count: np.ndarray, emit, latest_of) -> None:
    """Emit the points of these elements that may still come before the latest registers."""
    # The rungs that each element reaches: (0, 1], then (1, 2], (2, 4] ... below its count.
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    row = np.repeat(np.arange(len(element)), top)
    rung = np.arange(len(row)) - np.repeat(np.cumsum(top) - top, top)
    low = np.where(rung == 0, 0, 1 << np.maximum(rung - 1, 0)).astype(np.int64)
    size = np.maximum(low, 1)
    doc, el, w = of[row], element[row], count[row]
    seed = _seed(el, low, size, 0)
    at = -np.log(_uniform(seed)) / size
    inside = low + size <= w
    emit(doc[inside], seed[inside], at[inside])
    # What may still give points: range, its first point, whether that is counted, points drawn at this leaf.
    nodes = [doc, el, w, low, size, at, seed, inside, np.zeros(len(doc), np.int64)]
    while len(nodes[0]):
        latest = latest_of()
        near = nodes[5] < latest[nodes[0]]
        nodes = [x[near] for x in nodes]
        doc, el, w, low, size, at, seed, counted, drawn = nodes
        leaf = size == 1
        parts = []
        if leaf.any():
            d, e, b, t, k = doc[leaf], el[leaf], low[leaf], at[leaf], drawn[leaf]
            steps = int(np.clip(100_000 // len(d), 1, 64))
            index = k[:, None] + np.arange(1, steps + 1)
            s = _seed(e[:, None], b[:, None], 1, index)
            t = t[:, None] + np.cumsum(-np.log(_uniform(s)), axis=1)
            use = t < latest[d][:, None]
            r, c = np.nonzero(use)
            emit(d[r], s[r, c], t[r, c])
            parts.append([d, e, w[leaf], b, size[leaf], t[:, -1], s[:, -1], counted[leaf], k + steps])
        if not leaf.all():
            d, e, ww, b, half, t, s, cnt = (x[~leaf] for x in (doc, el, w, low, size, at, seed, counted))
            half = half // 2
            left = (mix(_seed(e, b, half, 1) ^ _C) & np.uint64(1)).astype(bool)
            for is_left in (True, False):
                lo = b if is_left else b + half
                keeps = left if is_left else ~left
                fresh = _seed(e, lo, half, 2)
                mine = np.where(keeps, s, fresh)
                when = np.where(keeps, t, t - np.log(_uniform(fresh)) / half)
                full = lo + half <= ww
                # a kept point counts now if its wider range had not been counted
                news = full & ~(keeps & cnt)
                emit(d[news], mine[news], when[news])
                alive = lo < ww
                parts.append([x[alive] for x in (d, e, ww, lo, half, when, mine, full, np.zeros(len(d), np.int64))])
        nodes = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [x[:0] for x in nodes]


def fingerprints(of: np.ndarray, element: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell multisets apart."""
    out = []
    for k in (_A, _B):
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, of, mix(element * k + count.astype(np.uint64)))
        out.append(sums.view(np.int64))
    return out[0], out[1]


def sign(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc_id, n, f1, f2, bands array<long>, bits array<long>, more array<long>): shingles, fingerprint, a key for
    each band, and the registers' lowest and second bits. One narrow pass."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n", "f1", "f2", "bands", "bits", "more"]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, f1, f2 = (np.zeros(len(texts), np.int64) for _ in range(3))
            keys, bits = np.zeros((len(texts), BANDS), np.int64), np.zeros((2, len(texts), WORDS), np.int64)
            for a, b in slices(texts, PIECE):
                of, element, count = multisets(texts[a:b], width)
                n[a:b] = np.bincount(of, count, b - a)
                f1[a:b], f2[a:b] = fingerprints(of, element, count, b - a)
                whole = signatures(of, element, count, b - a)
                for k in range(2):
                    bits[k, a:b] = np.packbits((whole >> k & 1).astype(np.uint8), axis=1).view(np.int64)
                sig = whole[:, : BANDS * WIDTH].astype(np.uint64).reshape(b - a, BANDS, WIDTH)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b - a, BANDS))
                for k in range(WIDTH):
                    key = mix(key * _A + sig[:, :, k])
                keys[a:b] = key.view(np.int64)
            lists = [pa.ListArray.from_arrays(np.arange(0, k * len(texts) + 1, k, dtype=np.int32), x.ravel()) for k, x in ((BANDS, keys), (WORDS, bits[0]), (WORDS, bits[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, f1, f2)), *lists], names=names)

    rows = docs.select(F.coalesce(id_of(), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, f1 long, f2 long, bands array<long>, bits array<long>, more array<long>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each sorted hashes and counts."""
    total = int(a[1].sum() + b[1].sum())
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both / (total - both) if total else 0.0


def verify(pairs: DataFrame, texts: DataFrame, least: float, width: int = 5) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. Each text is sent once for each pair it is in."""
    left = pairs.join(texts.toDF("a", "ta"), "a")
    both = left.join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = list(dict.fromkeys([*ta, *tb]))
            held = {}
            for i, j in slices(texts, PIECE):
                of, element, count = multisets(texts[i:j], width)
                ends = np.searchsorted(of, np.arange(j - i + 1))
                held.update((texts[i + k], (element[ends[k] : ends[k + 1]], count[ends[k] : ends[k + 1]])) for k in range(j - i))
            good = [overlap(held[x], held[y]) >= least for x, y in zip(ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(v, good, strict=True) if g], pa.int64()) for v in (a, b)], names=["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def _texts(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """Rows (rep, text), one for each multiset of keys (rep, low, f1, f2; low being one of its ids): few other texts are
    moved. A written table."""
    spark = docs.sparkSession
    small_batches(spark)
    # one filter for the ids, which are at hand, and the fingerprints, which tell the texts of one id apart
    bits = spark.sparkContext.broadcast(wanted_filter(keys.select(F.col("low").alias("v")).unionByName(keys.select(F.col("f1").alias("v"))), "v"))

    def run(batches):
        known: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted(bits.value, batch.column(0).to_numpy().view(np.uint64))))
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, PIECE):
                f1, f2 = fingerprints(*multisets(texts[a:b], width), b - a)
                some = np.flatnonzero(wanted(bits.value, f1.view(np.uint64)))
                if len(known) > 100_000:
                    known.clear()
                use = []
                for i in some.tolist():
                    # copies that this task has met already needn't be sent again
                    if (key := (int(f1[i]), int(f2[i]))) not in known:
                        known.add(key)
                        use.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(f1[use]), pa.array(f2[use]), pa.array([texts[a + i] for i in use], pa.string())], names=["f1", "f2", "text"])

    rows = docs.select(F.coalesce(id_of(), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    found = rows.mapInArrow(tidy(run), "f1 long, f2 long, text string")
    out = materialize(found.join(keys.select("rep", "f1", "f2"), ["f1", "f2"]).select("rep", "text").dropDuplicates(["rep"]), "texts")
    bits.destroy()
    return out


def _apart(left: str, right: str) -> Column:
    """In how many bits two sketches differ; compiled, unlike functions over arrays."""
    apart = F.lit(0)
    for i in range(WORDS):
        apart = apart + F.bit_count(F.col(f"{left}w{i}").bitwiseXOR(F.col(f"{right}w{i}")))
    return apart


def _apart_both(left: str, right: str) -> Column:
    """In how many registers the lowest or second bits differ; for the few pairs that are near by the lowest ones."""
    lowest = [F.array(*(F.col(f"{side}w{i}") for i in range(WORDS))) for side in (left, right)]
    differ = [F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)) for x, y in (lowest, (f"{left}more", f"{right}more"))]
    counts = F.zip_with(*differ, lambda p, q: F.bit_count(p.bitwiseOR(q)))
    return F.aggregate(counts, F.lit(0), lambda x, y: x + y)


def _buckets(coded: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, rep, band, sub, weight, w0 ...): the multisets of each bucket that several have, with their sketches;
    and rows (rep, bands, more) of all multisets.

    sub deals the members of a large bucket; weight is the number of members in all buckets of the multiset.
    """
    single = materialize(coded.where("n > 0").join(groups.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "bands", "bits", "more"), "single")
    keyed = single.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    full = join_by_key(keyed, sizes, ["key"], "size").withColumn("weight", F.sum("size").over(Window.partitionBy("rep")))
    full = full.withColumn("sub", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)))
    sketches = single.select("rep", *(F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(WORDS)))
    out = materialize(full.join(sketches, "rep").drop("size"), "buckets")
    discard(sizes)
    return out, single.select("rep", "bands", "more")


def _mixed(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components, with ``component`` and ``members``, its number of multisets."""
    if found is None:
        return materialize(buckets.withColumn("component", F.col("rep")).withColumn("members", F.lit(1).cast("long")), "mixed")
    sized = join_by_key(found, found.groupBy("component").agg(F.count("*").alias("members")), ["component"], "members")
    rows = buckets.join(sized.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("members", F.coalesce("members", F.lit(1)))
    rows = materialize(rows, "placed")
    mixed = rows.groupBy("key").agg(F.count("*").alias("times"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "times")
    out = materialize(join_by_key(rows, materialize(mixed, "keys"), ["key"], "times").drop("times"), "mixed")
    discard(rows)
    return out


def _untested(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    return pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _with_leaders(rows: DataFrame, done: DataFrame | None, step: int) -> DataFrame:
    """One pair (a, b) for each multiset that has an untested leader of another component among its buckets: the nearest."""
    rank = [F.desc("weight" if step == 0 else "members"), F.xxhash64("rep", F.lit(step)), F.col("rep")]
    w = Window.partitionBy("key", "sub").orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    led = rows.withColumn("lead", F.first(F.struct("rep", "component", *(f"w{i}" for i in range(WORDS)))).over(w))
    led = led.where("component <> lead.component").withColumn("apart", _apart("", "lead.")).where(F.col("apart") <= FAR)
    near = led.select("rep", "apart", *_ordered("rep", "lead.rep")).distinct()
    return _untested(near, done).groupBy("rep").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def _with_all(rows: DataFrame, bands: DataFrame, done: DataFrame | None) -> DataFrame:
    """All untested candidate pairs (a, b) of different components: in each bucket, the members of all components but
    its fullest meet all others, block by block. A pair that shares several buckets is taken from the first only."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    parts = parts.select("key", F.col("top.component").alias("top"), "n", F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("few"), F.ceil(F.col("n") / BLOCK).alias("all"))
    rows = join_by_key(rows, materialize(parts, "parts"), ["key"], "n").withColumn("minor", F.col("component") != F.col("top"))
    rows = materialize(rows.drop("sub", "weight", "members", "top", "n").join(bands, "rep"), "banded")
    part = lambda c: F.pmod(F.xxhash64("rep"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    x = rows.where("minor").withColumn("p", part("few")).withColumn("q", each("all")).alias("x")
    y = rows.withColumn("q", part("all")).withColumn("p", each("few")).alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    once = ~F.col("y.minor") | (F.col("x.rep") < F.col("y.rep"))
    earlier = F.arrays_overlap(F.slice("x.bands", F.lit(1), F.col("x.band")), F.slice("y.bands", F.lit(1), F.col("y.band")))
    pairs = x.join(y, met & once & (F.col("x.component") != F.col("y.component")) & (_apart("x.", "y.") <= FAR) & ~earlier & (_apart_both("x.", "y.") <= FAR_BOTH))
    near = materialize(_untested(pairs.select(*_ordered("x.rep", "y.rep")).distinct(), done), "near")
    discard(rows)
    return near


def _linked(docs: DataFrame, groups: DataFrame, buckets: DataFrame, bands: DataFrame, least: float, width: int, rounds: int) -> DataFrame | None:
    """The links (a, b) that connect all that candidate pairs connect; None if there are none."""
    links, done, found, some = None, None, None, True
    for step in range(rounds + 1):
        rows = _mixed(buckets, found)
        # the leaders have done their part once they find few links
        last = step == rounds or not some
        near = _with_all(rows, bands, done) if last else materialize(_with_leaders(rows, done, step), "near")
        tested = near.count()
        some = False
        if tested:
            ids = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
            texts = _texts(docs, groups.select("rep", "low", "f1", "f2").join(ids, "rep", "left_semi"), width)
            good = materialize(verify(near, texts, least, width), "links")
            discard(texts)
            done = near if done is None else done.unionByName(near)
            links = good if links is None else links.unionByName(good)
            linked = good.count()
            some = linked >= FEW * tested
            if not last and linked:
                found = materialize(components(links), "components")
        discard(rows)
        if last:
            break
    return links


def _of_one_id(coded: DataFrame, groups: DataFrame, same: list[str]) -> DataFrame | None:
    """Links (a, b) between the texts of each id that has several; None if no id has."""
    several = coded.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("x"), F.max(F.struct(*same)).alias("y"), F.count("*").alias("rows")).where("x <> y").select("doc_id", "rows")
    several = materialize(several, "several")
    if several.isEmpty():
        return None
    texts = materialize(join_by_key(coded.select("doc_id", *same), several, ["doc_id"], "rows").select("doc_id", *same).distinct(), "texts")
    owned = materialize(join_by_key(texts, groups.select(*same, "rep", "times"), same, "times").select("doc_id", "rep"), "owned")
    hub = materialize(owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("rows")), "hubs")
    return join_by_key(owned, hub, ["doc_id"], "rows").where("a <> rep").select("a", F.col("rep").alias("b"))


def classes(docs: DataFrame, *, least: float = 0.8, width: int = 5, rounds: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, class_id), one for each row of docs: the smallest doc_id of those connected by links.

    Bands and sketches are made for links of a similarity of LEAST or more; a smaller ``least`` is refused. There are
    at most ``rounds`` rounds of leaders; their number doesn't change the result.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more: the bands and sketches would lose links of {least}")
    # texts without words are told apart by their ids
    signed = sign(docs, width).withColumn("f1", F.when(F.col("n") > 0, F.col("f1")).otherwise(F.col("doc_id")))
    coded = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    same = ["n", "f1", "f2"]
    # one row for each multiset: its first row stands for it
    groups = materialize(coded.groupBy(*same).agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("times")), "groups")
    links = _linked(docs, groups, *_buckets(coded, groups), least, width, rounds)
    joint = _of_one_id(coded, groups, same)
    edges = [e for e in (links, joint) if e is not None]
    named = groups.select(*same, "times", F.col("low").alias("class_id"))
    if edges:
        found = materialize(components(edges[0].unionByName(edges[1]) if len(edges) > 1 else edges[0]), "components")
        placed = materialize(groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
        lowest = materialize(placed.groupBy("component").agg(F.min("low").alias("class_id"), F.count("*").alias("members")), "lowest")
        named = materialize(join_by_key(placed, lowest, ["component"], "members").select(*same, "times", "class_id"), "named")
    final = join_by_key(coded.select("doc_id", *same), named, same, "times")
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return final.select(back("doc_id"), F.col("n").alias("n_shingles"), back("class_id"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id, repeated rows once. Texts without words stay.

    The rows of one id stay or go together: a document that stays keeps each of its different texts (so no text without
    an id is dropped but for repeats), one that goes loses them all.
    """
    spark = docs.sparkSession
    found = classes(docs.select("doc_id", "text"), **options).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("class_id").eqNullSafe(F.col("doc_id")).alias("__stays"))
    ids = materialize(found.groupBy("__id").agg(F.count("*").alias("__times"), F.min("__stays").alias("__stays")), "ids")
    # only documents that may go or repeat are joined; the others stay where they are
    bits = spark.sparkContext.broadcast(wanted_filter(ids.where("__times > 1 or not __stays"), "__id"))
    maybe = F.pandas_udf(lambda s: pd.Series(wanted(bits.value, s.to_numpy().view(np.uint64))), "boolean")
    marked = docs.withColumn("__id", F.coalesce(id_of(), F.lit(NO_ID))).withColumn("__maybe", maybe("__id"))
    some = materialize(marked.where("__maybe").drop("__maybe"), "maybe")
    kept = materialize(join_by_key(some, ids, ["__id"], "__times").where("__stays").select(*(F.col(f"`{c}`") for c in docs.columns), "__times"), "kept")
    again = kept.where("__times > 1").drop("__times")
    empty = F.length(F.regexp_replace(text_of(), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")) == 0
    once = marked.where("not __maybe").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(kept.where("__times = 1").drop("__times"))
    return once.unionByName(again.where(~empty).dropDuplicates(["doc_id", "text"])).unionByName(again.where(empty))


def op6_bag_minhash(spark, sf_dir):
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id")))
