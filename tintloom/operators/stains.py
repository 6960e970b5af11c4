"""Stain bases from optical densities: the plane method (Macenko) and sparse dictionaries (Vahadane), both from aggregates."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONCENTRATION_PERCENTILE, DEFAULT_MAX_CONCENTRATIONS, DEFAULT_STAINS, MACENKO_TAIL, MIN_TISSUE_PIXELS, VAHADANE_LAMBDA, VAHADANE_ROUNDS
from ..functions.color import concentrations
from .tissue import od_tissue

#: Two unit stains whose products have no larger determinant are taken as equal.
EQUAL = 1e-12
PAIRS = ("rr", "rg", "rb", "gg", "gb", "bb")


def gram(tissue: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The six sums of products of optical densities, and the count."""
    return tissue.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.sum(F.col(f"od_{a}") * F.col(f"od_{b}")).alias(f"s_{a}{b}") for a, b in PAIRS))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def with_plane(sums: DataFrame, orientation: str = "as_reference") -> DataFrame:
    """Adds the plane of the two leading directions of the six sums: columns p_r0 ... p_b1, for each row.

    The eigenvalues of a symmetric 3 x 3 matrix have a closed form, and an eigenvector stands upright on the rows of the
    matrix less its value; so rows are fitted at once, whatever their number, and nothing goes to the driver.
    ``as_reference`` turns the first direction to a negative sum, which makes the angles wrap; ``positive`` turns it to a
    positive one. The sign of the second doesn't matter. Where a direction is arbitrary (equal values), it is upright on
    the others and on the axis that they have least of.
    """
    kept = sums.columns
    entry = lambda i, j: F.col(f"s_{'rgb'[min(i, j)]}{'rgb'[max(i, j)]}")
    df = sums.withColumn("_q", (entry(0, 0) + entry(1, 1) + entry(2, 2)) / 3)
    off = entry(0, 1) * entry(0, 1) + entry(0, 2) * entry(0, 2) + entry(1, 2) * entry(1, 2)
    df = df.withColumn("_p", F.sqrt((sum((entry(i, i) - F.col("_q")) * (entry(i, i) - F.col("_q")) for i in range(3)) + 2 * off) / 6))
    unit = lambda i, j: (entry(i, j) - (F.col("_q") if i == j else 0)) / F.when(F.col("_p") > 0, F.col("_p")).otherwise(1.0)
    det = _dot([unit(0, j) for j in range(3)], _cross([unit(1, j) for j in range(3)], [unit(2, j) for j in range(3)]))
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3)
    df = df.withColumn("_l0", F.col("_q") + 2 * F.col("_p") * F.cos("_phi")).withColumn("_l2", F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_phi") + float(2 * np.pi / 3)))
    for k in (0, 2):  # the three products of two rows each; the longest is taken
        rows = [[entry(i, j) - (F.col(f"_l{k}") if i == j else 0) for j in range(3)] for i in range(3)]
        for i in range(3):
            v = _cross(rows[i], rows[(i + 1) % 3])
            df = df.withColumn(f"_x{k}{i}", F.struct(_dot(v, v).alias("n"), *(c.alias(f"c{j}") for j, c in enumerate(v))))
        best = F.greatest(*(f"_x{k}{i}" for i in range(3)))
        df = df.withColumn(f"_v{k}", best)
    part = lambda k: [F.try_divide(F.col(f"_v{k}.c{j}"), F.sqrt(f"_v{k}.n")) for j in range(3)]
    tiny = lambda k: F.col(f"_v{k}.n") <= F.pow("_l0", F.lit(4.0)) * 1e-24

    def upright(v: list[Column]) -> list[Column]:
        """The axis that a direction has least of."""
        least = F.least(*(F.struct(F.abs(v[j]).alias("a"), F.lit(j).alias("j")) for j in range(3)))["j"]
        return [F.when(least == j, 1.0).otherwise(0.0) for j in range(3)]

    df = df.select(*kept, "_l0", "_v0", "_v2", *(c.alias(f"_w{j}") for j, c in enumerate(part(2))))
    w = [F.col(f"_w{j}") for j in range(3)]
    any_of_two = _cross(w, upright(w))
    length = F.sqrt(_dot(any_of_two, any_of_two))
    first = [F.when(~tiny(0), c).when(~tiny(2), F.try_divide(x, length)).otherwise(F.lit(float(j == 0))) for j, (c, x) in enumerate(zip(part(0), any_of_two, strict=True))]
    df = df.select(*kept, *(f"_w{j}" for j in range(3)), tiny(2).alias("_tiny"), *(c.alias(f"_f{j}") for j, c in enumerate(first)))
    f = [F.col(f"_f{j}") for j in range(3)]
    # the second direction is upright on the first and on the last
    last = [F.when(F.col("_tiny"), x).otherwise(c) for x, c in zip(upright(f), w, strict=True)]
    second = _cross(last, f)
    df = df.select(*kept, *(f"_f{j}" for j in range(3)), *(c.alias(f"_s{j}") for j, c in enumerate(second)))
    out, want = [], -1.0 if orientation == "as_reference" else 1.0
    for k, name in enumerate("fs"):
        v = [F.col(f"_{name}{j}") for j in range(3)]
        total = v[0] + v[1] + v[2]
        turn = F.try_divide(F.when(total * want < 0, -1.0).otherwise(1.0), F.sqrt(_dot(v, v)))
        out += [(v[j] * turn).alias(f"p_{c}{k}") for j, c in enumerate("rgb")]
    return df.select(*kept, *out)


def angles(tissue: DataFrame, plane) -> DataFrame:
    """Adds the angle of each pixel within the plane: 3 x 2 numbers, or columns."""
    part = lambda i, k: F.lit(float(plane[i][k])) if isinstance(plane[i][k], (int, float, np.floating)) else plane[i][k]
    p = [sum(part(i, k) * F.col(f"od_{c}") for i, c in enumerate("rgb")) for k in range(2)]
    return tissue.withColumn("angle", F.atan2(p[1], p[0]))


def with_concentrations(rows: DataFrame, stains=DEFAULT_STAINS) -> DataFrame:
    c = concentrations([F.col(f"od_{k}") for k in "rgb"], stains)
    return rows.select("*", c[0].alias("c0"), c[1].alias("c1"))


def fit_macenko_by(colours: DataFrame, by: list[str], orientation: str = "as_reference") -> DataFrame:
    """Rows (by, h_r, h_g, h_b, e_r, e_g, e_b, max0, max1, n, fallback): stains and high concentrations of each group.

    colours: by, r, g, b, times (distinct colours, at most 2**24 a group). Groups with too few stained pixels get the
    default. Three aggregations, all groups at once.
    """
    tissue = od_tissue(colours)
    weighted = lambda a, b: F.sum(F.col("times") * F.col(f"od_{a}") * F.col(f"od_{b}"))
    sums = tissue.groupBy(*by).agg(F.sum("times").alias("n"), *(weighted(a, b).alias(f"s_{a}{b}") for a, b in PAIRS))
    planes = with_plane(sums.where(F.col("n") >= MIN_TISSUE_PIXELS), orientation).select(*by, "n", *(f"p_{c}{k}" for k in (0, 1) for c in "rgb"))
    seen = angles(tissue.join(planes.drop("n"), by), [[F.col(f"p_{c}{k}") for k in (0, 1)] for c in "rgb"])
    tails = F.array(F.lit(MACENKO_TAIL), F.lit(1 - MACENKO_TAIL))
    ends = seen.groupBy(*by).agg(F.percentile("angle", tails, F.col("times")).alias("ends"))
    both = planes.join(ends, by)
    for k in (0, 1):
        t = F.get("ends", F.lit(k))
        both = both.withColumns({f"_{k}{c}": F.col(f"p_{c}0") * F.cos(t) + F.col(f"p_{c}1") * F.sin(t) for c in "rgb"})
        v = [F.col(f"_{k}{c}") for c in "rgb"]
        both = both.withColumns({f"_{k}{c}": F.col(f"_{k}{c}") / F.sqrt(_dot(v, v)) for c in "rgb"})
    swap = F.col("_0r") > F.col("_1r")  # the stain with less red comes first
    stain = {f"{name}_{c}": F.when(swap, F.col(f"_{1 - k}{c}")).otherwise(F.col(f"_{k}{c}")) for k, name in enumerate("he") for c in "rgb"}
    stains = both.select(*by, "n", *(v.alias(k) for k, v in stain.items()))
    # least squares: the inverse of the stains' products, times the stains; two equal stains share a density
    row = {k: [F.col(f"{k}_{c}") for c in "rgb"] for k in "he"}
    a, b, d = _dot(row["h"], row["h"]), _dot(row["h"], row["e"]), _dot(row["e"], row["e"])
    det = a * d - b * b
    weight = lambda k, c: (d * F.col(f"h_{c}") - b * F.col(f"e_{c}") if k == 0 else a * F.col(f"e_{c}") - b * F.col(f"h_{c}")) / det
    part = stains.withColumns({f"w{k}{c}": F.when(det > EQUAL, weight(k, c)).otherwise(F.col(f"{'he'[k]}_{c}") / 2) for k in (0, 1) for c in "rgb"})
    c = [sum(F.col(f"w{k}{c}") * F.col(f"od_{c}") for c in "rgb") for k in (0, 1)]
    top = tissue.join(part, by).select(*by, "times", *(v.alias(f"c{k}") for k, v in enumerate(c))).groupBy(*by)
    top = top.agg(*(F.percentile(f"c{k}", F.lit(CONCENTRATION_PERCENTILE), F.col("times")).alias(f"max{k}") for k in (0, 1)))
    found = colours.select(*by).distinct().join(stains.drop("n").join(top, by), by, "left").join(sums.select(*by, "n"), by, "left")
    default = {f"{k}_{c}": float(DEFAULT_STAINS[i][j]) for i, k in enumerate("he") for j, c in enumerate("rgb")} | {f"max{k}": float(DEFAULT_MAX_CONCENTRATIONS[k]) for k in (0, 1)}
    return found.select(*by, *(F.coalesce(k, F.lit(v)).alias(k) for k, v in default.items()), F.coalesce("n", F.lit(0)).alias("n"), F.col("h_r").isNull().alias("fallback"))


def fit_of(row) -> dict:
    """Stain matrix and high concentrations of a row of ``fit_macenko_by``."""
    return {"stain_matrix": np.array([[row[f"{k}_{c}"] for c in "rgb"] for k in "he"]), "max_concentrations": np.array([row["max0"], row["max1"]])}


def fit_macenko(pixels: DataFrame, orientation: str = "as_reference") -> dict:
    """Stain matrix and high concentrations of the stained pixels; the default with too few of them."""
    return fit_macenko_colours(pixels.groupBy("r", "g", "b").agg(F.count("*").alias("times")), orientation)


def fit_macenko_colours(colours: DataFrame, orientation: str = "as_reference") -> dict:
    """The same from distinct colours (r, g, b, times), of which there are at most 2**24."""
    held = colours.withColumn("one", F.lit(1)).persist(StorageLevel.DISK_ONLY)  # four steps take them
    try:
        row = fit_macenko_by(held, ["one"], orientation).first()
    finally:
        held.unpersist()
    return fit_of(row) if row else {"stain_matrix": np.array(DEFAULT_STAINS), "max_concentrations": np.array(DEFAULT_MAX_CONCENTRATIONS)}


def _taking_part(atoms: np.ndarray, penalty: float) -> Column:
    """Which atoms the sparse non-negative mixture closest to a density has: 0 none, 1 the first, 2 the second, 3 both.

    Either both have a positive share, or the one that fits better takes part if it fits at all.
    """
    g = float(atoms[0] @ atoms[1])
    hit = [sum(F.lit(float(atoms[k][i])) * F.col(f"od_{c}") for i, c in enumerate("rgb")) - penalty for k in (0, 1)]
    alone = F.when(F.greatest(*hit) <= 0, 0).when(hit[0] >= hit[1], 1).otherwise(2)
    return alone if 1 - g * g < 1e-12 else F.when((hit[0] > g * hit[1]) & (hit[1] > g * hit[0]), 3).otherwise(alone)


def _updated(atoms: np.ndarray, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], penalty: float) -> np.ndarray:
    """The atoms after one descent over them, for the mixtures of these atoms. With the same atoms taking part a mixture
    is linear in the density, so the sums of densities and of their products say all."""
    a, b = np.zeros((2, 2)), np.zeros((2, 3))
    for part, (weight, first, second) in sums.items():
        own = [k for k in (0, 1) if part >> k & 1]
        if not own:
            continue
        m, shift = np.zeros((2, 3)), np.zeros(2)
        inverse = np.linalg.inv(atoms[own] @ atoms[own].T)
        m[own], shift[own] = inverse @ atoms[own], -penalty * inverse.sum(1)
        a += m @ second @ m.T + np.outer(m @ first, shift) + np.outer(shift, m @ first) + weight * np.outer(shift, shift)
        b += m @ second + np.outer(shift, first)
    atoms = atoms.copy()
    for k in (0, 1):
        if a[k, k] > 1e-12:
            new = np.maximum(0, (b[k] - a[k, 1 - k] * atoms[1 - k]) / a[k, k])
            norm = np.linalg.norm(new)
            atoms[k] = new / norm if norm > 1e-6 else atoms[k]
    return atoms


def positive_dictionary(colours: DataFrame, penalty: float = VAHADANE_LAMBDA, rounds: int = VAHADANE_ROUNDS, settled: float = 1e-7) -> np.ndarray:
    """Two non-negative unit atoms whose sparse non-negative mixtures come closest to the densities (od_r, od_g, od_b, times).

    Alternates exact codes with a descent over the atoms, from the default stains, until a descent moves them no more. A
    round is one aggregation of ten sums for each set of atoms that take part; with these the driver descends several
    times before colours are dealt to the sets anew. Rows stay where they are, and the atoms travel.
    """
    atoms = np.array(DEFAULT_STAINS) / np.linalg.norm(DEFAULT_STAINS, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    x = [F.col(f"od_{c}") for c in "rgb"]
    for _ in range(rounds):
        weighted = [F.sum(F.col("times") * v) for v in (*x, *(x[i] * x[j] for i, j in pairs))]
        found = colours.groupBy(_taking_part(atoms, penalty).alias("part")).agg(F.sum("times"), *weighted).collect()  # 4 rows at most
        sums = {}
        for r in found:
            second = np.zeros((3, 3))
            for (i, j), v in zip(pairs, r[5:], strict=True):
                second[i, j] = second[j, i] = v
            sums[r[0]] = float(r[1]), np.array(r[2:5], float), second
        before, atoms = atoms, _updated(atoms, sums, penalty)
        if np.abs(atoms - before).max() < settled:
            break
        for _ in range(rounds):
            last, atoms = atoms, _updated(atoms, sums, penalty)
            if np.abs(atoms - last).max() < settled / 10:
                break
    return atoms


def fit_vahadane(pixels: DataFrame) -> dict:
    """Stain matrix of the stained pixels, the stain with more blue first."""
    return fit_vahadane_colours(pixels.groupBy("r", "g", "b").agg(F.count("*").alias("times")))


def fit_vahadane_colours(colours: DataFrame) -> dict:
    """The same from distinct colours (r, g, b, times). All of them count, so there is no sample to draw."""
    tissue = od_tissue(colours).select("od_r", "od_g", "od_b", "times").persist(StorageLevel.DISK_ONLY)
    try:
        if (tissue.agg(F.sum("times")).first()[0] or 0) < MIN_TISSUE_PIXELS:
            return {"stain_matrix": np.array(DEFAULT_STAINS)}
        atoms = positive_dictionary(tissue)
    finally:
        tissue.unpersist()
    return {"stain_matrix": atoms if atoms[0, 2] >= atoms[1, 2] else atoms[::-1]}
