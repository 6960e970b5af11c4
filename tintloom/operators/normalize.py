"""The normalizers, over long pixels as DataFrame expressions and over packed tiles as NumPy in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKGROUND_L, CONCENTRATION_EPS, CONCENTRATION_PERCENTILE, REINHARD_SIGMA_FLOOR
from ..functions import color
from ..sources.pixels import TILES, array_of
from . import stats
from .quality import no_clock
from .stains import with_concentrations
from .tissue import background, with_od

TILE = ["slide_id", "tx", "ty"]
LIMITS = ((0.0, 100.0), (-128.0, 127.0), (-128.0, 127.0))


@dataclass
class Profile:
    """What a target looks like: at most 768 numbers, so it travels with the tasks."""

    kind: str
    cdf: np.ndarray | None = None
    mu: np.ndarray | None = None
    sigma: np.ndarray | None = None
    stains: np.ndarray | None = None
    max_concentrations: np.ndarray | None = None
    extra: dict = field(default_factory=dict)


def cdf_profile(cdfs: DataFrame) -> Profile:
    """From dense rows (ch, v, cdf)."""
    out = np.zeros((256, 3))
    for r in cdfs.select("ch", "v", "cdf").collect():
        out[r["v"], "RGB".index(r["ch"])] = r["cdf"]
    return Profile("histogram", cdf=out)


def stats_profile(row) -> Profile:
    return Profile("reinhard", mu=np.array([row[f"mu_{c}"] for c in "lab"]), sigma=np.array([row[f"sigma_{c}"] for c in "lab"]))


def stain_profile(kind: str, fit: dict) -> Profile:
    return Profile(kind, stains=np.asarray(fit["stain_matrix"]), max_concentrations=fit.get("max_concentrations"))


# Long pixels.


def lut_rows(cdfs: DataFrame, profile: Profile) -> DataFrame:
    """Adds ``lut``: the smallest target value whose CDF reaches the source's. The target is three literal arrays."""
    target = F.when(F.col("ch") == "R", F.lit(profile.cdf[:, 0].tolist())).when(F.col("ch") == "G", F.lit(profile.cdf[:, 1].tolist())).otherwise(F.lit(profile.cdf[:, 2].tolist()))
    return cdfs.withColumn("lut", F.size(F.filter(target, lambda t: t < F.col("cdf"))))


def luts(pixels: DataFrame, profile: Profile, by: list[str]) -> DataFrame:
    """One row a group with three tables of 256 values. A group sends its counts, 768 at most, and gets its tables."""
    target = profile.cdf

    @F.pandas_udf("lut_r array<int>, lut_g array<int>, lut_b array<int>")
    def tables(channels: pd.Series, values: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = []
        for ch, v, n in zip(channels, values, counts, strict=True):
            own = np.zeros((3, 256), np.int64)
            own[np.asarray(ch), np.asarray(v)] = n
            shares = own.cumsum(1) / np.maximum(own.sum(1, keepdims=True), 1)
            out.append([np.searchsorted(target[:, i], shares[i], "left").astype(np.int32) for i in range(3)])
        return pd.DataFrame({f"lut_{c}": [t[i] for t in out] for i, c in enumerate("rgb")})

    rows = stats.histogram(pixels, by).groupBy(*by).agg(F.collect_list(F.struct((F.instr(F.lit("RGB"), F.col("ch")) - 1).alias("ch"), "v", "n")).alias("counts"))
    return rows.select(*by, tables("counts.ch", "counts.v", "counts.n").alias("luts")).select(*by, "luts.*")


def histogram_match(pixels: DataFrame, profile: Profile, by: list[str] = TILE) -> DataFrame:
    """Adds r2, g2, b2. The source distribution is that of each group, so tiles are matched one by one."""
    joined = pixels.join(luts(pixels, profile, by), by)
    return joined.select(*pixels.columns, *(F.get(f"lut_{c}", F.col(c)).alias(f"{c}2") for c in "rgb"))


def reinhard(pixels: DataFrame, profile: Profile, source: DataFrame | None = None, by: list[str] = TILE) -> DataFrame:
    """Adds r2, g2, b2: each LAB channel takes on the target's mean and deviation, unless it is flat.

    source: statistics by ``by``; those of each group itself if there are none.
    """
    own = stats.lab_stats(pixels, by) if source is None else source.select(*by, *stats.STATS)
    lab = color.rgb_to_lab(pixels).join(own, by)
    moved = []
    for i, c in enumerate("lab"):
        v, sigma = F.col(f"{c}_"), F.col(f"sigma_{c}")
        shifted = (v - F.col(f"mu_{c}")) / sigma * F.lit(float(profile.sigma[i])) + F.lit(float(profile.mu[i]))
        moved.append(color.clamp(F.when(sigma > REINHARD_SIGMA_FLOOR, shifted).otherwise(v), *LIMITS[i]).alias(f"{c}_"))
    return color.lab_to_rgb(lab.select(*pixels.columns, *moved)).drop("l_", "a_", "b_")


def _from_concentrations(rows: DataFrame, columns: list[str], stains: np.ndarray) -> DataFrame:
    mixed = [F.lit(float(stains[0][i])) * F.col("c0") + F.lit(float(stains[1][i])) * F.col("c1") for i in range(3)]
    return rows.select(*columns, *(color.od_to_rgb(m).alias(f"{c}2") for m, c in zip(mixed, "rgb", strict=True)))


def macenko(pixels: DataFrame, profile: Profile, by: list[str] = TILE) -> DataFrame:
    """Adds r2, g2, b2: the target's stains, each group's high concentrations scaled to the target's."""
    rows = with_concentrations(with_od(pixels), profile.stains.tolist())
    w = Window.partitionBy(*by)
    high = [F.percentile(c, F.lit(CONCENTRATION_PERCENTILE)).over(w).alias(f"p{c}") for c in ("c0", "c1")]
    rows = rows.select(*pixels.columns, "c0", "c1", *high)
    scaled = [(F.col(c) * F.lit(float(m)) / (F.col(f"p{c}") + F.lit(CONCENTRATION_EPS))).alias(c) for c, m in zip(("c0", "c1"), profile.max_concentrations, strict=True)]
    return _from_concentrations(rows.select(*pixels.columns, *scaled), pixels.columns, profile.stains)


def vahadane(pixels: DataFrame, profile: Profile) -> DataFrame:
    """Adds r2, g2, b2: non-negative concentrations in the target's stains. A projection, without a shuffle."""
    rows = with_concentrations(with_od(pixels), profile.stains.tolist())
    rows = rows.select(*pixels.columns, *(F.greatest(c, F.lit(0.0)).alias(c) for c in ("c0", "c1")))
    return _from_concentrations(rows, pixels.columns, profile.stains)


def apply(pixels: DataFrame, profile: Profile, source: DataFrame | None = None, by: list[str] = TILE) -> DataFrame:
    if profile.kind == "histogram":
        return histogram_match(pixels, profile, by)
    if profile.kind == "reinhard":
        return reinhard(pixels, profile, source, ["slide_id"] if source is not None else by)
    return macenko(pixels, profile, by) if profile.kind == "macenko" else vahadane(pixels, profile)


def keep_background(normalized: DataFrame) -> DataFrame:
    """White where the source was background; the source's statistics included those pixels."""
    return background(normalized).select(*[c for c in normalized.columns if c[-1] != "2"], *(F.when(F.col("bg"), 255).otherwise(F.col(f"{c}2")).cast("int").alias(f"{c}2") for c in "rgb"))


# Packed tiles.


def np_histogram_match(image: np.ndarray, profile: Profile) -> np.ndarray:
    out = np.empty_like(image)
    for i in range(3):
        own = profile.extra["source_cdf"][i] if "source_cdf" in profile.extra else np.cumsum(np.bincount(image[..., i].ravel(), minlength=256)) / image[..., i].size
        out[..., i] = np.searchsorted(profile.cdf[:, i], own, "left").clip(0, 255).astype(np.uint8)[image[..., i]]
    return out


def np_reinhard(image: np.ndarray, profile: Profile) -> np.ndarray:
    lab = color.np_rgb_to_lab(image)
    mu, sigma = (profile.extra[k] if k in profile.extra else f(lab.reshape(-1, 3), axis=0) for k, f in (("source_mu", np.mean), ("source_sigma", np.std)))
    for i in range(3):
        if sigma[i] > REINHARD_SIGMA_FLOOR:
            lab[..., i] = (lab[..., i] - mu[i]) / sigma[i] * profile.sigma[i] + profile.mu[i]
        lab[..., i] = np.clip(lab[..., i], *LIMITS[i])
    return color.np_lab_to_rgb(lab)


def _np_concentrations(image: np.ndarray, profile: Profile) -> np.ndarray:
    return color.np_rgb_to_od(image).reshape(-1, 3) @ color.ols_weights(profile.stains).T


def np_macenko(image: np.ndarray, profile: Profile) -> np.ndarray:
    c = _np_concentrations(image, profile)
    c = c * profile.max_concentrations / (np.percentile(c, 100 * CONCENTRATION_PERCENTILE, axis=0) + CONCENTRATION_EPS)
    return color.np_od_to_rgb(c @ profile.stains).reshape(image.shape)


def np_vahadane(image: np.ndarray, profile: Profile) -> np.ndarray:
    return color.np_od_to_rgb(_np_concentrations(image, profile).clip(0, None) @ profile.stains).reshape(image.shape)


_REGISTRY: dict[str, Callable] = {"histogram": np_histogram_match, "reinhard": np_reinhard, "macenko": np_macenko, "vahadane": np_vahadane}


def register_normalizer(kind: str, function: Callable[[np.ndarray, Profile], np.ndarray]) -> None:
    """Add a normalizer of one's own: it takes a tile and a profile of that kind, and gives a tile."""
    _REGISTRY[kind] = function


@dataclass(frozen=True)
class Method:
    """A normalizer of one's own with its fit.

    partial: numbers that a tile adds, always equally many; those of all sampled tiles are summed within their tasks and
    then over all, and finish makes a profile of ``kind`` from the sums. apply takes a tile and that profile.
    """

    kind: str
    apply: Callable[[np.ndarray, Profile], np.ndarray]
    partial: Callable[[np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], Profile]


METHODS: dict[str, Method] = {}


def register_method(method: Method) -> None:
    """Make a method known by its kind: ``JobConfig(own=kind)`` takes it."""
    register_normalizer(method.kind, method.apply)
    METHODS[method.kind] = method


def fit_method(tiles: DataFrame, method: Method) -> Profile:
    """The target of packed tiles (h, w, pixels). Only sums travel, as many rows a task as a tile has numbers."""
    partial = method.partial

    def run(batches):
        total = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = np.asarray(partial(array_of(r.pixels, r.h, r.w)), np.float64).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = tiles.select("h", "w", "pixels").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    rows = dict((r["i"], r["v"]) for r in sums.collect())  # as many as a tile has numbers
    if not rows:
        raise RuntimeError("there are no tiles to fit")
    return method.finish(np.array([rows[i] for i in range(len(rows))]))


def np_with_background(image: np.ndarray, profile: Profile, function: Callable | None = None) -> np.ndarray:
    bg = color.np_rgb_to_lab(image)[..., 0] >= BACKGROUND_L
    if bg.all():
        return np.full_like(image, 255)
    out = (function or _REGISTRY[profile.kind])(image, profile).copy()
    out[bg] = 255
    return out


#: A slide's own LAB moments beside its tiles; null where each tile has its own.
SOURCE = ("source_mu", "source_sigma")


def with_moments(tiles: DataFrame, moments: DataFrame | None) -> DataFrame:
    """Tiles with their slide's moments (slide_id, mu_l ... sigma_b), or nulls: a row a slide, joined by slide."""
    if moments is None:
        return tiles.withColumns({c: F.lit(None).cast("array<double>") for c in SOURCE})
    side = moments.select("slide_id", *(F.array(*(f"{k}_{c}" for c in "lab")).alias(name) for k, name in zip(("mu", "sigma"), SOURCE, strict=True)))
    return tiles.join(side, "slide_id", "left")


def of_slide(profile: Profile, row) -> Profile:
    """The profile, with the moments of the row's slide if it has some."""
    if row.source_mu is None:
        return profile
    return replace(profile, extra=profile.extra | {k: np.asarray(getattr(row, k)) for k in SOURCE})


def normalize_tiles(tiles: DataFrame, profile: Profile, pad_to: int | None = None, keep_errors: bool = False, *, moments: DataFrame | None = None, clock=no_clock) -> DataFrame:
    """Packed tiles, normalized; with ``pad_to`` edge tiles are filled up with white. One narrow pass.

    With ``keep_errors`` rows also have ``seconds``, and ``error`` where a tile couldn't be read, as its row says, or the
    normalizer fails (without pixels then). moments: LAB moments by slide, in place of each tile's own.
    """
    function = _REGISTRY[profile.kind]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                began = time.perf_counter()
                try:
                    if row.pixels is None:
                        raise ValueError(row.error)
                    with clock("algo.normalize"):
                        image = np_with_background(array_of(row.pixels, int(row.h), int(row.w)), of_slide(profile, row), function)
                except Exception as e:
                    if not keep_errors:
                        raise
                    out.append((row.slide_id, row.tx, row.ty, row.h, row.w, None, time.perf_counter() - began, str(e) or type(e).__name__))
                    continue
                if pad_to:
                    full = np.full((pad_to, pad_to, 3), 255, np.uint8)
                    full[: image.shape[0], : image.shape[1]] = image
                    image = full
                out.append((row.slide_id, row.tx, row.ty, *image.shape[:2], image.tobytes(), time.perf_counter() - began, None))
            frame = pd.DataFrame(out, columns=["slide_id", "tx", "ty", "h", "w", "pixels", "seconds", "error"])
            yield frame.astype({"tx": "Int32", "h": "Int32", "w": "Int32"})

    if "error" not in tiles.columns:
        tiles = tiles.withColumn("error", F.lit(None).cast("string"))
    rows = with_moments(tiles.select("slide_id", "tx", "ty", "h", "w", "pixels", "error"), moments)
    out = rows.mapInPandas(run, f"{TILES}, seconds double, error string")
    return out if keep_errors else out.drop("seconds", "error")


def tile_histograms(tiles: DataFrame) -> DataFrame:
    """Rows (slide_id, ch, v, n) of packed tiles: 768 counts leave a task for each slide it has met."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slide, pixels in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(slide, np.zeros((3, 256), np.int64))
                image = np.frombuffer(pixels.as_buffer(), np.uint8).reshape(-1, 3)  # a view of the batch
                for i in range(3):
                    own[i] += np.bincount(image[:, i], minlength=256)
            if len(sums) > 1_000:
                yield counted(sums)
                sums = {}
        if sums:
            yield counted(sums)

    def counted(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        n = len(sums)
        columns = [np.repeat(np.array(list(sums), np.int32), 768), np.tile(np.repeat(list("RGB"), 256), n), np.tile(np.arange(256, dtype=np.int32), 3 * n), np.concatenate([x.ravel() for x in sums.values()])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slide_id", "ch", "v", "n"])

    counts = tiles.select("slide_id", "pixels").mapInArrow(run, "slide_id int, ch string, v int, n long")
    return counts.groupBy("slide_id", "ch", "v").agg(F.sum("n").alias("n"))
