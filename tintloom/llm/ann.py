"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are taken relative to a centre (the mean of a bounded sample), rotated by a random orthogonal matrix,
and kept as the signs of their components, packed 64 to a word, with two correction scalars: the length of the
residual, and the inner product of the residual's direction with its code. A query is rotated once and quantised to
a few bits, so that its inner product with a code is a sum of bit counts. The estimate's error is bounded by
eps * sqrt((1 - f^2) / (f^2 (dim - 1))), f being the second scalar. Of each
block of candidates, those whose bound reaches the k-th best lower bound are reranked by exact cosines in double
precision.

Each vector is encoded once. Queries and candidates, with codes and vectors, meet in blocks of bounded size; each block
sends its k nearest of each query, and the overall k nearest are chosen from those. (Codes alone would be a tenth of
the bytes, but where vectors point in all directions a quarter of all candidates are within the bounds, and a join that
fetches the vectors of these moves more.) Ties go to the smaller vec_id. Vectors that are null, zero or hold null or
non-finite components take no part; vectors of different length aren't compared. Rows that repeat a vec_id are
candidates of their own, except for queries of that id; a query id with several vectors asks for the first of them in
order of its bytes. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .vectors import matrix, sample_rows, unit_vectors

CANDIDATES, QUERIES = 8192, 4096
QUERY_BITS = 6


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, residual lengths, and inner products of the residuals' directions with their codes."""
    rest = (x - centre) @ turn
    length = np.sqrt((rest**2).sum(1))
    fit = np.abs(rest).sum(1) / np.where(length > 0, length, 1) / np.sqrt(x.shape[1])
    return _pack(rest > 0), length, np.where(length > 0, fit, 1.0)


def estimate(codes: np.ndarray, length: np.ndarray, fit: np.ndarray, base: float, query: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the coded vectors with a rotated query, and their error bounds.

    base: the query's inner product with the centre.
    """
    dim = len(query)
    low, top = query.min(), query.max()
    step = (top - low) / (2**QUERY_BITS - 1) or 1.0
    level = np.rint((query - low) / step).astype(np.int64)
    planes = _pack(((level[None, :] >> np.arange(QUERY_BITS)[:, None]) & 1).astype(np.uint8))
    ones = np.bitwise_count(codes).sum(1).astype(np.int64)
    weighed = np.zeros(len(codes), np.int64)
    for j in range(QUERY_BITS):
        weighed += np.bitwise_count(codes & planes[j]).sum(1).astype(np.int64) << j
    # sum over set bits of the query, less the sum over the others
    inner = (2 * (low * ones + step * weighed) - (low * dim + step * level.sum())) / np.sqrt(dim)
    rounding = step / 2 * np.sqrt(dim)
    norm = float(np.sqrt((query**2).sum()))
    spread = eps * norm * np.sqrt(np.maximum(0.0, 1 - fit**2) / max(1, dim - 1)) + rounding
    return base + length * inner / fit, length * spread / fit


def search_block(x: np.ndarray, ids: np.ndarray, coded: tuple, q: np.ndarray, q_ids: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, eps: float) -> list[tuple]:
    """The k nearest of each query in one block: rows (query, vec, score)."""
    out = []
    rotated, base = q @ turn, q @ centre
    for i, own in enumerate(q_ids.tolist()):
        about, error = estimate(*coded, base[i], rotated[i], eps)
        other = ids != own
        lower = np.where(other, about - error, -np.inf)
        n = int(other.sum())
        if not n:
            continue
        bar = np.partition(lower, len(lower) - min(k, n))[len(lower) - min(k, n)]
        near = np.flatnonzero(other & (about + error >= bar))
        # summed row by row, so that equal vectors have equal scores
        score = (x[near] * q[i]).sum(1)
        best = np.lexsort((ids[near], -score))[:k]
        out += [(own, int(ids[near[j]]), float(score[j])) for j in best]
    return out


def with_codes(units: DataFrame, centre: np.ndarray) -> DataFrame:
    """units with (code binary, length double, fit double). One narrow pass."""

    def run(batches):
        for batch in batches:
            dims, units = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            code, length, fit = [b""] * len(units), np.zeros(len(units)), np.zeros(len(units))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                words, length[at], fit[at] = encode(matrix([units[i] for i in at], dim), middle(centre, dim), rotation(dim))
                for i, row in zip(at.tolist(), words, strict=True):
                    code[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(length), pa.array(fit)], names=["vec_id", "label", "dim", "unit", "code", "length", "fit"])

    return units.select("vec_id", "label", "dim", "unit").mapInArrow(run, "vec_id long, label string, dim int, unit binary, code binary, length double, fit double")


def middle(centre: np.ndarray, dim: int) -> np.ndarray:
    """The centre, or zeros for vectors of another dimension."""
    return centre if len(centre) == dim else np.zeros(dim)


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", eps: float = 1.9, most_sample: int = 10_000) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest of each query found among rows, without the query's own id."""
    small_batches(rows.sparkSession)
    all_ = materialize(unit_vectors(rows, vec_id, embedding), "units")
    wanted = materialize(unit_vectors(queries, vec_id, embedding).groupBy("vec_id").agg(F.min(F.struct("dim", "unit")).alias("x")).select("vec_id", "x.dim", "x.unit"), "queries")
    sample = sample_rows(all_, most_sample)
    centre = sample.mean(0) if len(sample) else np.zeros(1)
    blocks = lambda df, size, name: df.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = blocks(all_, CANDIDATES, "c").join(blocks(wanted, QUERIES, "q"), "dim")
    part = lambda name: F.pmod(F.xxhash64("vec_id", "unit"), F.col(name)).cast("int")
    span = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    c = with_codes(all_, centre).join(F.broadcast(parts), "dim").withColumn("cb", part("c")).withColumn("qb", span("q"))  # parts: a row a dimension
    q = wanted.join(F.broadcast(parts), "dim").withColumn("qb", part("q")).withColumn("cb", span("c"))
    place = ["dim", "cb", "qb"]
    no_code = [F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("length"), F.lit(0.0).alias("fit")]
    both = c.select(*place, F.lit(False).alias("is_query"), "vec_id", "unit", "code", "length", "fit").unionByName(q.select(*place, F.lit(True).alias("is_query"), "vec_id", "unit", *no_code))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        asks, given = rows[rows.is_query], rows[~rows.is_query]
        found = []
        if len(asks) and len(given):
            dim = int(rows.dim.iloc[0])
            codes = np.frombuffer(b"".join(given.code), "<u8").reshape(len(given), -1)
            coded = codes, given.length.to_numpy(), given.fit.to_numpy()
            found = search_block(matrix(given.unit, dim), given.vec_id.to_numpy(), coded, matrix(asks.unit, dim), asks.vec_id.to_numpy(), middle(centre, dim), rotation(dim), k, eps)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    some = both.groupBy(*place).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_one_bit_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
