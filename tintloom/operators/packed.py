"""Sampling and statistics straight on packed tiles: the throughput form of ``grid``, ``tissue`` and ``stats``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import THUMBNAIL, WHITE_LEVEL, WHITE_SHARE
from ..functions.color import np_rgb_to_lab
from ..sources.pixels import array_of
from . import stains
from .quality import no_clock

WINDOWS = "slide_id int, seq int, x int, y int, h int, w int, pixels binary"


def cut_windows(tiles: DataFrame, grid: DataFrame, tile: int) -> DataFrame:
    """The sampled windows as packed tiles, black outside the slide.

    Each window meets at most four tiles; only those that a window meets are shuffled.
    """
    lo = lambda c: F.floor(F.col(c) / F.lit(float(tile))).cast("int")
    hi = lambda c: F.floor((F.col(c) + tile - 1) / F.lit(float(tile))).cast("int")
    wanted = grid.select("slide_id", "seq", "x", "y", F.explode(F.sequence(lo("x"), hi("x"))).alias("tx")).select("*", F.explode(F.sequence(lo("y"), hi("y"))).alias("ty"))
    met = wanted.join(tiles.select("slide_id", "tx", "ty", "h", "w", "pixels"), ["slide_id", "tx", "ty"], "left")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = int(rows.x.iloc[0]), int(rows.y.iloc[0])
        out = np.zeros((tile, tile, 3), np.uint8)
        for r in rows.itertuples(index=False):
            if r.pixels is None:
                continue
            image = array_of(r.pixels, int(r.h), int(r.w))
            x0, y0 = r.tx * tile - x, r.ty * tile - y
            a, b = max(0, y0), max(0, x0)
            c, d = min(tile, y0 + image.shape[0]), min(tile, x0 + image.shape[1])
            if a < c and b < d:
                out[a:c, b:d] = image[a - y0 : c - y0, b - x0 : d - x0]
        return pd.DataFrame({"slide_id": [rows.slide_id.iloc[0]], "seq": [rows.seq.iloc[0]], "x": [x], "y": [y], "h": [tile], "w": [tile], "pixels": [out.tobytes()]})

    return met.groupBy("slide_id", "seq").applyInPandas(one, WINDOWS)


def window_stats(windows: DataFrame, clock=no_clock) -> DataFrame:
    """Score, white share, histogram (768 counts) and LAB moments of each packed window. One narrow pass.

    If windows have an ``error``, so has the result, and nothing else where there is one.
    """
    names = ["slide_id", "seq", "x", "y", "score", "white_frac", "mostly_white", "hist", "mu", "sigma"]
    with_error = "error" in windows.columns

    def measure(r):
        image = array_of(r.pixels, r.h, r.w).reshape(-1, 3)
        n, v = 3 * len(image), image.astype(np.int64)
        total, squares = int(v.sum()), int((v * v).sum())
        white = int((v.sum(1) > 3 * WHITE_LEVEL).sum())
        lab = np_rgb_to_lab(image)
        hist = np.concatenate([np.bincount(image[:, i], minlength=256) for i in range(3)])
        return float(np.sqrt(float(n * squares - total * total)) / n), white / len(image), white >= WHITE_SHARE * len(image), hist.tolist(), lab.mean(0).tolist(), lab.std(0).tolist()

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.pixels is None:
                    found = (None,) * 6
                else:
                    with clock("algo.sample"):
                        found = measure(r)
                out.append((r.slide_id, r.seq, r.x, r.y, *found, *([r.error] if with_error else [])))
            frame = pd.DataFrame(out, columns=[*names, *(["error"] if with_error else [])])
            yield frame.astype({"mostly_white": "boolean"})

    schema = "slide_id int, seq int, x int, y int, score double, white_frac double, mostly_white boolean, hist array<long>, mu array<double>, sigma array<double>"
    return windows.mapInPandas(run, schema + ", error string" * with_error)


def histogram_rows(stats: DataFrame) -> DataFrame:
    """Rows (slide_id, ch, v, n) summed over windows."""
    long = stats.select("slide_id", F.posexplode("hist").alias("at", "n"))
    ch = F.when(F.col("at") < 256, "R").when(F.col("at") < 512, "G").otherwise("B")
    return long.groupBy("slide_id", ch.alias("ch"), (F.col("at") % 256).cast("int").alias("v")).agg(F.sum("n").alias("n"))


def colours(tiles: DataFrame) -> DataFrame:
    """Distinct colours of the packed tiles of each slide with their counts: a tile sends each of its colours once."""

    def run(batches):
        for batch in batches:
            for slide, pixels in zip(batch.slide_id, batch.pixels, strict=True):
                image = np.frombuffer(pixels, np.uint8).reshape(-1, 3).astype(np.int32)
                code, n = np.unique(image[:, 0] << 16 | image[:, 1] << 8 | image[:, 2], return_counts=True)
                yield pd.DataFrame({"slide_id": np.int32(slide), "code": code, "n": n})

    counts = tiles.select("slide_id", "pixels").mapInPandas(run, "slide_id int, code int, n long").groupBy("slide_id", "code").agg(F.sum("n").alias("times"))
    return counts.select("slide_id", F.shiftright("code", 16).alias("r"), F.shiftright("code", 8).bitwiseAND(255).alias("g"), F.col("code").bitwiseAND(255).alias("b"), "times")


def thumbnails(tiles: DataFrame, slides: DataFrame, tile: int, max_size: int = THUMBNAIL) -> DataFrame:
    """Small pictures of slides: rows (slide_id, x, y, r, g, b), of area means, with borders in proportion.

    The longest side is ``max_size``, both are cut to whole pixels, and none is enlarged. A tile sends the sums of the
    target pixels it meets. Shares are whole numbers (a source pixel is as many units wide as the target is pixels), so
    sums are exact, in whatever order they are added. tiles: slide_id, tx, ty, h, w, pixels; slides: slide_id, width, height.
    """
    longest = F.greatest("width", "height")
    side = lambda c: F.when(longest <= max_size, F.col(c)).otherwise(F.greatest(F.lit(1), F.floor(F.col(c) * F.lit(max_size) / longest).cast("int")))
    sizes = slides.select("slide_id", "width", "height", side("width").alias("tw"), side("height").alias("th"))

    def shares(begin: int, n: int, size: int, target: int) -> tuple[int, np.ndarray]:
        """The first target pixel that n source pixels from `begin` meet, and the units of each that lie in each."""
        first, last = begin * target // size, ((begin + n) * target - 1) // size
        at, of = np.arange(begin, begin + n)[None] * target, np.arange(first, last + 1)[:, None] * size
        return first, np.maximum(0, np.minimum(at + target, of + size) - np.maximum(at, of))

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                n_y, n_x = min(r.h, r.height - r.ty * tile), min(r.w, r.width - r.tx * tile)
                if n_y <= 0 or n_x <= 0:
                    continue
                image = array_of(r.pixels, r.h, r.w)[:n_y, :n_x].astype(np.int64)
                y0, down = shares(r.ty * tile, n_y, r.height, r.th)
                x0, across = shares(r.tx * tile, n_x, r.width, r.tw)
                sums = np.einsum("ty,yxc->txc", down, image)
                sums = np.einsum("sx,txc->tsc", across, sums)
                y, x = np.mgrid[y0 : y0 + len(down), x0 : x0 + len(across)]
                yield pd.DataFrame({"slide_id": r.slide_id, "x": x.ravel(), "y": y.ravel(), "area": r.width * r.height, **{c: sums[..., i].ravel() for i, c in enumerate("rgb")}})

    rows = tiles.join(sizes, "slide_id").select("slide_id", "tx", "ty", "h", "w", "pixels", "width", "height", "tw", "th")
    sums = rows.mapInPandas(run, "slide_id int, x int, y int, area long, r long, g long, b long").groupBy("slide_id", "x", "y", "area").agg(*(F.sum(c).alias(c) for c in "rgb"))
    return sums.select("slide_id", "x", "y", *(F.expr(f"cast((2 * {c} + area) div (2 * area) as int)").alias(c) for c in "rgb"))


def fit_slides(tiles: DataFrame, orientation: str = "as_reference") -> DataFrame:
    """Stains and high concentrations of each slide from its packed tiles, all slides at once (``stains.fit_macenko_by``)."""
    return stains.fit_macenko_by(colours(tiles), ["slide_id"], orientation)
