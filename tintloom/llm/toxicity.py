"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is that a hashed character n-gram occurs once, twice or four times at least in the lower-cased text with
its white space collapsed. Its value is the log ratio of its smoothed document frequencies in toxic and other texts; logistic regression with an
L2 penalty weighs these values. N-grams whose frequencies hardly differ are left out. Labels are learnt only from
rows whose crc32(doc_id as text) mod 5 is not 0.

The fit sees at most `most_rows` labelled documents and `most_bytes` bytes of their text, chosen by a hash of doc_id;
documents of more than `most_share` of these bytes (all rows of the id together) come after all others, shortest
first, and those of more than `most_bytes` are left out. All rows are scored, each text whole; rows that repeat get
the same score each. Null texts count as empty; a text without known n-grams gets the base rate. A null doc_id is
held out. Labels that are null or of missing documents are ignored; several labels of one document count by their
mean (1 from 0.5 on). Without labels of both kinds every score is the base rate (0 if there are no labels). An empty
table gives an empty result. Other columns are not read, whatever their names; `clean` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, materialize, mix, slices, small_batches, table, text_of

SIZES = (3, 4, 5, 6)
#: N-grams are hashed into 2**BITS buckets; a bucket gives a feature for each of LEVELS that its count in a text reaches.
BITS = 18
LEVELS = (1, 2, 4)
SPACE = len(LEVELS) << BITS
#: About so many characters are worked on at once.
PIECE = 200_000


@dataclass(frozen=True)
class Model:
    """place: for each place in the feature space its number or -1; weight: of each feature, ratio included."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def held_out(column: str = "doc_id") -> Column:
    """Rows that are never learnt from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of the lower-cased texts with their white space collapsed, a zero between two texts."""
    plain = [" " + " ".join(t.lower().replace("\0", " ").split()) + " " for t in texts]
    return np.frombuffer("\0".join(plain).encode("utf-32-le", "surrogatepass"), "<u4")


def ngrams(codes: np.ndarray, begins: int | None = None):
    """For each size of n-gram: the index of the text and the bucket, for every place (the first ``begins`` ones)."""
    of = np.cumsum(codes == 0, dtype=np.int32)
    wide, value = codes.astype(np.uint64), np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        value = value[: max(0, len(codes) - n + 1)] * np.uint64(0x100000001B3) + wide[n - 1 :]
        if n in SIZES:
            k = len(value) if begins is None else min(begins, len(value))
            whole = (of[:k] == of[n - 1 : n - 1 + k]) & (codes[:k] != 0)
            yield of[:k][whole], (mix(value[:k][whole] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32)


def _used(place: np.ndarray) -> np.ndarray:
    """The buckets of which some level has a feature."""
    return (place.reshape(len(LEVELS), -1) >= 0).any(0)


def _counts(texts: list[str], used: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts, fewer than 2**(31 - BITS), or of one long one: index of the text, bucket, and count, in order.

    A long text is counted piece by piece, so that the working arrays are as small as for the others.
    """
    if len(texts) == 1 and len(texts[0]) > PIECE:
        codes, total = _codes(texts), np.zeros(1 << BITS, np.int64)
        for begin in range(0, len(codes), PIECE):
            for _, bucket in ngrams(codes[begin : begin + PIECE + max(SIZES) - 1], PIECE):
                total += np.bincount(bucket, minlength=1 << BITS)
        found = np.flatnonzero(total if used is None else total * used)
        return np.zeros(len(found), np.int64), found, total[found]
    keys = []
    for of, bucket in ngrams(_codes(texts)):
        if used is not None:
            known = used[bucket]
            of, bucket = of[known], bucket[known]
        keys.append(of << BITS | bucket)
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own = key[first]
    return (own >> BITS).astype(np.int64), (own & ((1 << BITS) - 1)).astype(np.int64), np.diff(np.append(first, len(key)))


def features(texts: list[str], place: np.ndarray | None = None, used: np.ndarray | None = None):
    """The features of the texts, slice by slice: begin and end of the slice, index of the text within it, and places
    in the feature space, or with ``place`` (and ``used``, what is known of it) their numbers."""
    for a, b in slices(texts, PIECE):
        of, bucket, counts = _counts(texts[a:b], used)
        found = [(of[counts >= least], bucket[counts >= least] + (level << BITS)) for level, least in enumerate(LEVELS)]
        of, feature = (np.concatenate(x) for x in zip(*found, strict=True))
        if place is not None:
            feature = place[feature]
            of, feature = of[feature >= 0], feature[feature >= 0].astype(np.int64)
        order = np.argsort(of, kind="stable")
        yield a, b, of[order], feature[order]


def _fit_weights(of: np.ndarray, feature: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; the driver holds the features of the bounded sample."""
    x, n = ratio[feature], len(y)
    w, bias = np.zeros(len(ratio)), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_bias, rate = w, bias, 4.0 / (1 + (np.bincount(of, x * x, n).max() if len(x) else 0) + penalty)
    for k in range(steps):
        z = np.bincount(of, x * ahead[feature], n) + ahead_bias
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = ahead - rate * (np.bincount(feature, x * g[of], len(w)) / n * 10 + penalty * ahead / n * 10)
        new_bias = ahead_bias - rate * g.mean() * 10
        step = k / (k + 3)
        ahead, ahead_bias = new + step * (new - w), new_bias + step * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 12_000, most_bytes: int = 64_000_000, most_share: float = 1 / 8, least_z: float = 5.0, most_features: int = 8192, smooth: float = 2.0, penalty: float = 1.0, steps: int = 300) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(id_of().alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(id_of().alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most most_rows rows
    # the bound in bytes is taken before the texts move; large documents wait, so that none cuts off the others
    sizes = texts.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size")).where(F.col("size") <= most_bytes)
    late = F.when(F.col("size") > most_bytes * most_share, F.col("size")).otherwise(0)
    upto = F.sum("size").over(Window.orderBy(late, F.xxhash64("doc_id"), "doc_id"))
    kept = [r[0] for r in sizes.select("doc_id", upto.alias("upto")).where(F.col("upto") <= most_bytes).select("doc_id").collect()]
    kept_ids = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    sample = materialize(texts.join(F.broadcast(kept_ids), "doc_id").repartition(8, "doc_id"), "labelled")

    def frequencies(batches):
        both = np.zeros((2, SPACE), np.int64)
        for batch in batches:
            own, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for a, b, of, place in features(own):
                np.add.at(both.reshape(-1), y[a:b][of] * SPACE + place, 1)
        at = np.flatnonzero(both.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0, at]), pa.array(both[1, at])], names=["bucket", "n0", "n1"])

    totals = {int(r["y"]): r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    none = Model(np.full(SPACE, -1, np.int32), np.zeros(0), float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n1 + n0 else -745.0)
    if not n0 or not n1:
        return none
    df = sample.select("text", "y").mapInArrow(frequencies, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") - n1 * share) / F.sqrt(n1 * share * (1 - share) + 1e-9)
    best = df.where(share < 1).withColumn("z", F.abs(z)).where((F.col("z") >= least_z) & (F.col("n0") + F.col("n1") >= 4)).orderBy(F.desc("z"), "bucket").limit(most_features).collect()
    if not best:
        return none
    place = none.place.copy()
    place[[r["bucket"] for r in best]] = np.arange(len(best))
    a, b = (np.array([r[k] for r in best], float) for k in ("n0", "n1"))
    prior = (a + b) / (n0 + n1)
    ratio = np.log((b + smooth * prior) / (n1 + smooth)) - np.log((a + smooth * prior) / (n0 + smooth))

    used = _used(place)

    def known(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            for i, j, of, feature in features(own, place, used):
                ends = np.searchsorted(of, np.arange(1, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], pa.array([x.tolist() for x in np.split(feature, ends)], pa.list_(pa.int32()))], names=["y", "features"])

    # most_rows rows of known features, as two flat arrays
    rows = sample.select("text", "y").mapInArrow(known, "y double, features array<int>").toArrow().combine_chunks()
    y, lists = rows.column("y").to_numpy(), rows.column("features")
    of = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    feature = pc.list_flatten(lists).to_numpy()
    del rows, lists
    w, bias = _fit_weights(of, feature, ratio, y, penalty, steps)
    return Model(place, w * ratio, bias)


def _scores(texts: list[str], model: Model, used: np.ndarray) -> np.ndarray:
    z = np.full(len(texts), model.bias)
    for a, b, of, feature in features(texts, model.place, used):
        z[a:b] += np.bincount(of, model.weight[feature], b - a) if len(of) else 0
    return 1 / (1 + np.exp(-np.clip(z, -745, 700)))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs. One narrow pass: no shuffle."""
    small_batches(docs.sparkSession)
    used = _used(model.place)

    def run(batches):
        for batch in batches:
            p = _scores(batch.column(1).to_pylist(), model, used)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(id_of().alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that the model rejects, their columns as they are. Each text is sent once."""
    small_batches(docs.sparkSession)
    used, at = _used(model.place), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            own = batch.column(at).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array(_scores([t or "" for t in own], model, used) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
