"""Tissue: scores, predicates and filters of tiles and pixels. Sums are integers, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKGROUND_L, IQR_MULTIPLIER, MIN_VALID_TILES, OD_THRESHOLD, SAVE_MIN_SCORE, TMA_TOP_PERCENTILE, WHITE_LEVEL, WHITE_SHARE
from ..functions.color import CHANNELS, lightness, rgb_to_od


def score_of(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation of n values from exact integer sums."""
    return F.sqrt((n * squares - total * total).cast("double")) / n


def scored(pixels: DataFrame, by: list[str], area: int | None = None) -> DataFrame:
    """Score and share of near-white pixels of each group.

    ``area``: the pixels a whole window has; those that are missing count as black.
    """
    value = F.col("r") + F.col("g") + F.col("b")
    square = F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")
    sums = pixels.groupBy(*by).agg(F.sum(value).alias("total"), F.sum(square).alias("squares"), F.sum((value > 3 * WHITE_LEVEL).cast("long")).alias("white"), F.count("*").alias("seen"))
    n = F.lit(area).cast("long") if area else F.col("seen")
    share = F.col("white").cast("double") / n
    return sums.select(*by, score_of(3 * n, F.col("total"), F.col("squares")).alias("score"), share.alias("white_frac"), (F.col("white") >= F.lit(WHITE_SHARE) * n).alias("mostly_white"))


def sampled(grid: DataFrame, windows: DataFrame, tile: int) -> DataFrame:
    """Scores of all windows of a grid; one without a pixel inside the slide is all black."""
    own = scored(windows, ["slide_id", "seq"], tile * tile)
    return grid.join(own, ["slide_id", "seq"], "left").select("slide_id", "seq", "x", "y", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("white_frac", F.lit(0.0)).alias("white_frac"), F.coalesce("mostly_white", F.lit(False)).alias("mostly_white"))


def biopsy_valid(tiles: DataFrame) -> DataFrame:
    """Adds ``valid``: not below the lower fence of the scores, and not mostly white."""
    w = Window.partitionBy("slide_id")
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.75))).over(w)
    return tiles.withColumn("q", q).withColumn("valid", (F.col("score") >= F.col("q")[0] - IQR_MULTIPLIER * (F.col("q")[1] - F.col("q")[0])) & ~F.col("mostly_white")).drop("q")


def tma_valid(tiles: DataFrame) -> DataFrame:
    """Adds ``valid``: in the top quarter of the scores."""
    return tiles.withColumn("valid", F.col("score") >= F.percentile("score", F.lit(TMA_TOP_PERCENTILE / 100)).over(Window.partitionBy("slide_id")))


def with_fallback(tiles: DataFrame) -> DataFrame:
    """Adds valid_count, total_count, fallback and ``used``: all tiles where too few are valid."""
    w = Window.partitionBy("slide_id")
    out = tiles.select("*", F.sum(F.col("valid").cast("int")).over(w).alias("n_valid"), F.count("*").over(w).alias("total_count"))
    few = F.col("n_valid") < MIN_VALID_TILES
    return out.select(*tiles.columns, F.when(few, F.col("total_count")).otherwise(F.col("n_valid")).cast("int").alias("valid_count"), F.col("total_count").cast("int").alias("total_count"), few.alias("fallback"), (F.col("valid") | few).alias("used"))


def background(pixels: DataFrame) -> DataFrame:
    """Adds ``bg``: lightness at or above the threshold."""
    return lightness(pixels, out="__l").withColumn("bg", F.col("__l") >= F.lit(BACKGROUND_L)).drop("__l")


def save_skips(tiles: DataFrame) -> DataFrame:
    """Adds ``skipped``: tiles that are not saved, being mostly white or flat."""
    return tiles.withColumn("skipped", F.col("mostly_white") | (F.col("score") < F.lit(SAVE_MIN_SCORE)))


def with_od(pixels: DataFrame) -> DataFrame:
    """Adds optical densities od_r, od_g, od_b."""
    return pixels.select("*", *(rgb_to_od(F.col(c)).alias(f"od_{c}") for c in CHANNELS))


def od_tissue(pixels: DataFrame) -> DataFrame:
    """Pixels dense enough to be stained, with their optical densities."""
    return with_od(pixels).where(F.sqrt(F.col("od_r") * F.col("od_r") + F.col("od_g") * F.col("od_g") + F.col("od_b") * F.col("od_b")) > F.lit(OD_THRESHOLD))


def readable(rows: DataFrame, what: str = "slides") -> DataFrame:
    """Rows without an error; raises if none is left."""
    kept = rows.where("error is null")
    if not kept.limit(1).count():
        raise RuntimeError(f"none of the {what} could be read")
    return kept
