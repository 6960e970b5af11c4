"""What the two operators on vectors share: reading them, and spherical k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = None) -> DataFrame:
    """Rows (vec_id, label, dim, unit binary) of the vectors that take part: double components scaled to length 1.

    Left out: null and zero vectors, and those with null or non-finite components. One narrow pass.
    """
    key = F.col(label).cast("string") if label else F.lit("")
    wanted = rows.select(F.col(vec_id).cast("long").alias("vec_id"), key.alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    wanted = wanted.where("vec_id is not null and label is not null and e is not null and size(e) > 0")

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(sizes)
            units, keep = [], []
            for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                v = flat[end - size : end]
                # scaled first, so that squares neither overflow nor vanish
                top = np.abs(v).max()
                if np.isfinite(v).all() and top > 0:
                    v = v / top
                    units.append((v / np.sqrt(v @ v)).tobytes())
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([int(sizes[i]) for i in keep], pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "unit"])

    return wanted.mapInArrow(run, "vec_id long, label string, dim int, unit binary")


def matrix(values, dim: int) -> np.ndarray:
    """Rows of doubles from binary values."""
    return np.frombuffer(b"".join(values), float).reshape(-1, dim)


def sample_rows(units: DataFrame, most: int, seed: int = 0) -> np.ndarray:
    """At most ``most`` distinct vectors of the commonest dimension, by a hash of the id: the bounded sample a fit sees."""
    total = units.count()
    # the share is a little larger than wanted, so that the sort sees few rows however large the table is
    share = min(1.0, 1.2 * most / max(total, 1) + 0.001 * (total < 100 * most))
    mark = F.xxhash64("vec_id", F.lit(seed))
    got = units.where(F.pmod(mark, F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("dim", "unit", mark.alias("mark"), "vec_id").orderBy("mark", "vec_id").limit(most).collect()
    if not got:
        return np.zeros((0, 1))
    dims = [r["dim"] for r in got]
    dim = max(set(dims), key=dims.count)
    return np.unique(matrix([r["unit"] for r in got if r["dim"] == dim], dim), axis=0)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres; each row belongs to the centre of the largest cosine."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[: min(k, len(rows))]]
    for _ in range(rounds):
        of = np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        norms = np.sqrt((sums**2).sum(1))
        fresh = norms > 1e-12
        centres[fresh] = sums[fresh] / norms[fresh, None]
    return centres
