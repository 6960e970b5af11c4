"""Statistics: histograms, distribution functions and LAB moments, of tiles, slides and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import rgb_to_lab
from .grid import sampling_grid, windows
from .tissue import biopsy_valid, sampled, tma_valid, with_fallback


def long_channels(pixels: DataFrame, by: list[str]) -> DataFrame:
    return pixels.select(*by, F.expr("stack(3, 'R', r, 'G', g, 'B', b) as (ch, v)"))


def histogram(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, ch, v, n) of the values that occur; partial sums keep the shuffle to 768 rows a group and task."""
    return long_channels(pixels, by).groupBy(*by, "ch", "v").agg(F.count("*").alias("n"))


def dense(hist: DataFrame, by: list[str]) -> DataFrame:
    """The same with all 256 values."""
    keys = hist.select(*by, "ch").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return keys.join(hist, [*by, "ch", "v"], "left").select(*by, "ch", "v", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def cdf(hist: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, ch, v, cdf)."""
    w = Window.partitionBy(*by, "ch")
    running = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select(*by, "ch", "v", (running.cast("double") / F.sum("n").over(w)).alias("cdf"))


def sample(pixels: DataFrame, slides: DataFrame, slide_type: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """The scored windows of each slide with ``used``, and the pixels under them."""
    grid = sampling_grid(slides, slide_type, tile)
    under = windows(grid, pixels, tile)
    tiles = sampled(grid, under, tile)
    return with_fallback(biopsy_valid(tiles) if slide_type == "biopsy" else tma_valid(tiles)), under


def used_pixels(tiles: DataFrame, under: DataFrame) -> DataFrame:
    return under.join(tiles.where("used").select("slide_id", "seq"), ["slide_id", "seq"])


def used_colours(tiles: DataFrame, under: DataFrame, tile: int) -> DataFrame:
    """Distinct colours of the slides' used windows: rows (slide_id, r, g, b, times), black padding included."""
    seen = used_pixels(tiles, under).groupBy("slide_id", "r", "g", "b").agg(F.count("*").alias("times"))
    area = tiles.where("used").groupBy("slide_id").agg((F.count("*") * tile * tile).alias("area"))
    inside = seen.groupBy("slide_id").agg(F.sum("times").alias("n"))
    black = area.join(inside, "slide_id", "left").select("slide_id", *(F.lit(0).alias(c) for c in "rgb"), (F.col("area") - F.coalesce("n", F.lit(0))).alias("times"))
    return seen.unionByName(black.where("times > 0"))


def slide_cdf(pixels: DataFrame, slides: DataFrame, slide_type: str, tile: int) -> DataFrame:
    """Dense CDFs of the slides' used windows, with valid_count, total_count and fallback.

    Black padding is part of a window: it counts at value 0.
    """
    tiles, under = sample(pixels, slides, slide_type, tile)
    kept = tiles.where("used")
    area = kept.groupBy("slide_id").agg((F.count("*") * tile * tile).alias("area"), F.first("valid_count").alias("valid_count"), F.first("total_count").alias("total_count"), F.first("fallback").alias("fallback"))
    grid = area.select("*", F.explode(F.array(*map(F.lit, "RGB"))).alias("ch")).select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    hist = grid.join(histogram(used_pixels(tiles, under), ["slide_id"]), ["slide_id", "ch", "v"], "left")
    hist = hist.select("slide_id", "ch", "v", "area", "valid_count", "total_count", "fallback", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("slide_id", "ch")
    missing = F.col("area") - F.sum("n").over(w)
    running = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + missing
    return hist.select("slide_id", "ch", "v", (running.cast("double") / F.col("area")).alias("cdf"), "valid_count", "total_count", "fallback")


def pixel_weighted_cdf(pixels: DataFrame) -> DataFrame:
    """One profile of all slides: histograms are summed, so large slides weigh more."""
    return cdf(dense(histogram(pixels, []), []), [])


def slide_weighted_cdf(cdfs: DataFrame) -> DataFrame:
    """One profile of all slides: the mean of their dense CDFs, every slide weighing the same.

    The values are folded in the order of slides, so that the sum is the same however rows are partitioned.
    """
    ordered = F.array_sort(F.collect_list(F.struct("slide_id", "cdf")))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, s: acc + s["cdf"])
    return cdfs.groupBy("ch", "v").agg((total / F.count("*")).alias("cdf"))


def lab_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of L, a, b of each group."""
    lab = rgb_to_lab(pixels)
    return lab.groupBy(*by).agg(*(f(c).alias(f"{name}_{c[0]}") for c in ("l_", "a_", "b_") for name, f in (("mu", F.avg), ("sigma", F.stddev_pop))))


STATS = [f"{name}_{c}" for c in "lab" for name in ("mu", "sigma")]


def mean_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Plain means of means and of deviations, every row weighing the same."""
    return stats.groupBy(*by).agg(*(F.avg(c).alias(c) for c in STATS))


def slide_lab_stats(pixels: DataFrame, slides: DataFrame, slide_type: str, tile: int) -> DataFrame:
    """LAB statistics of each slide: the mean over its used windows, black padding included, with the counts."""
    tiles, under = sample(pixels, slides, slide_type, tile)
    kept = tiles.where("used")
    own = rgb_to_lab(used_pixels(tiles, under)).groupBy("slide_id", "seq").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in ("l_", "a_", "b_")), *(F.sum(F.col(c) * F.col(c)).alias(f"q{c}") for c in ("l_", "a_", "b_")))
    area = float(tile * tile)
    both = kept.join(own, ["slide_id", "seq"], "left").na.fill(0.0)  # black has L = a = b = 0
    stats = both.select("slide_id", "valid_count", "total_count", "fallback", *(e for c in ("l_", "a_", "b_") for e in ((F.col(f"s{c}") / area).alias(f"mu_{c[0]}"), F.sqrt(F.greatest(F.col(f"q{c}") / area - F.pow(F.col(f"s{c}") / area, F.lit(2.0)), F.lit(0.0))).alias(f"sigma_{c[0]}"))))
    return stats.groupBy("slide_id").agg(*(F.avg(c).alias(c) for c in STATS), F.first("valid_count").alias("valid_count"), F.first("total_count").alias("total_count"), F.first("fallback").alias("fallback"))
