"""Levels of a pyramid, each reduced from full resolution by a box mean; and white padding of edge tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(slides: DataFrame, tile: int) -> DataFrame:
    """Rows (slide_id, level, factor, w, h): halving while both sides stay above two tiles; there is a first level in any case."""
    k = F.explode(F.sequence(F.lit(1), F.lit(20))).alias("level")
    rows = slides.select("slide_id", "width", "height", k).withColumn("factor", F.expr("shiftleft(1, level)"))
    large = F.expr(f"width div factor > {2 * tile} and height div factor > {2 * tile}")
    return rows.where(large | (F.col("level") == 1)).select("slide_id", "level", "factor", F.expr("cast((width + factor - 1) div factor as int)").alias("w"), F.expr("cast((height + factor - 1) div factor as int)").alias("h"))


def reduce_by(pixels: DataFrame, factor: int) -> DataFrame:
    """Box means over factor x factor pixels, rounded half up; blocks at the edge average what exists. Partial sums first."""
    means = [F.expr(f"cast((2 * sum({c}) + count(*)) div (2 * count(*)) as int)").alias(c) for c in ("r", "g", "b")]
    return pixels.groupBy("slide_id", F.expr(f"cast(x div {factor} as int)").alias("x"), F.expr(f"cast(y div {factor} as int)").alias("y")).agg(*means)


def retile(pixels: DataFrame, tile: int) -> DataFrame:
    return pixels.select("slide_id", F.expr(f"cast(x div {tile} as int)").alias("tx"), F.expr(f"cast(y div {tile} as int)").alias("ty"), "x", "y", "r", "g", "b")


def pad_white(pixels: DataFrame, grid: DataFrame, tile: int, names=("r", "g", "b")) -> DataFrame:
    """Every tile of the grid at full size; what the slide doesn't cover is white."""
    span = F.sequence(F.lit(0), F.lit(tile - 1))
    full = grid.select("slide_id", "tx", "ty", F.explode(span).alias("dx")).select("*", F.explode(span).alias("dy"))
    full = full.select("slide_id", "tx", "ty", (F.col("tx") * tile + F.col("dx")).alias("x"), (F.col("ty") * tile + F.col("dy")).alias("y"))
    return full.join(pixels.select("slide_id", "tx", "ty", "x", "y", *names), ["slide_id", "tx", "ty", "x", "y"], "left").select("slide_id", "tx", "ty", "x", "y", *(F.coalesce(c, F.lit(255)).alias(c) for c in names))
