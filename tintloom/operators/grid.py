"""Row generators: the full tile grid, the sampling grids, and the windows of pixels under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BIOPSY_GRID, TILE_SIZE, TMA_GRID
from ..functions.names import tile_name


def full_grid(slides: DataFrame, tile: int = TILE_SIZE) -> DataFrame:
    """All tiles of each slide in row-major order, with the cropped size of edge tiles and the file name."""
    rows = slides.select("slide_id", "width", "height", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / tile).cast("int") - 1)).alias("ty"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / tile).cast("int") - 1)).alias("tx"))
    x, y = F.col("tx") * tile, F.col("ty") * tile
    return cells.select("slide_id", "tx", "ty", x.alias("x"), y.alias("y"), F.least(F.lit(tile), F.col("width") - x).alias("w"), F.least(F.lit(tile), F.col("height") - y).alias("h"), tile_name(F.col("slide_id"), F.col("tx"), F.col("ty")).alias("file"))


def _axis(index: str, size: str, tile: int, n: int) -> Column:
    """Evenly spaced from one tile to two tiles before the end, floored; negative or falling on small slides."""
    i = F.col(index)
    step = (F.col(size) - 3 * tile).cast("double") / F.lit(float(n - 1))
    return F.when(i == n - 1, F.col(size) - 2 * tile).otherwise(F.floor(F.lit(float(tile)) + i * step)).cast("int")


def sampling_grid(slides: DataFrame, kind: str, tile: int = TILE_SIZE, n: int | None = None) -> DataFrame:
    """Rows (slide_id, seq, x, y): ``biopsy`` from the centre outward, ``tma`` column by column."""
    n = n or {"biopsy": BIOPSY_GRID, "tma": TMA_GRID}[kind]
    ends = F.sequence(F.lit(0), F.lit(n - 1))
    cells = slides.select("slide_id", "width", "height", F.explode(ends).alias("i")).select("*", F.explode(ends).alias("j"))
    cells = cells.select("slide_id", "width", "height", "i", "j", _axis("i", "width", tile, n).alias("x"), _axis("j", "height", tile, n).alias("y"))
    if kind == "tma":
        return cells.select("slide_id", (F.col("i") * n + F.col("j")).cast("int").alias("seq"), "x", "y")
    away = F.pow(F.col("x") - F.col("width") / 2.0, F.lit(2.0)) + F.pow(F.col("y") - F.col("height") / 2.0, F.lit(2.0))
    seq = F.row_number().over(Window.partitionBy("slide_id").orderBy(away, "i", "j")) - 1
    return cells.select("slide_id", seq.alias("seq"), "x", "y")


def windows(grid: DataFrame, pixels: DataFrame, tile: int = TILE_SIZE) -> DataFrame:
    """The pixels under each sampled window: rows (slide_id, seq, x, y, px, py, r, g, b).

    What lies outside the slide is black. A window overlaps at most four tiles, so it is joined to
    pixels by tile: an equi join, with the bounds as a filter.
    """
    lo = lambda c: F.floor(F.col(c) / F.lit(float(tile))).cast("int")
    hi = lambda c: F.floor((F.col(c) + tile - 1) / F.lit(float(tile))).cast("int")
    keyed = grid.select("*", F.explode(F.sequence(lo("x"), hi("x"))).alias("tx")).select("*", F.explode(F.sequence(lo("y"), hi("y"))).alias("ty"))
    p = pixels.select("slide_id", "tx", "ty", F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")
    inside = keyed.join(p, ["slide_id", "tx", "ty"]).where(f"px >= x and px < x + {tile} and py >= y and py < y + {tile}")
    return inside.select("slide_id", "seq", "x", "y", "px", "py", "r", "g", "b")


def padded_windows(grid: DataFrame, pixels: DataFrame, tile: int = TILE_SIZE) -> DataFrame:
    """As ``windows``, with a black row for each place outside the slide."""
    span = F.sequence(F.lit(0), F.lit(tile - 1))
    places = grid.select("*", F.explode(span).alias("dx")).select("*", F.explode(span).alias("dy"))
    places = places.select("slide_id", "seq", "x", "y", (F.col("x") + F.col("dx")).alias("px"), (F.col("y") + F.col("dy")).alias("py"))
    p = pixels.select("slide_id", F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")
    return places.join(p, ["slide_id", "px", "py"], "left").select("slide_id", "seq", "x", "y", "px", "py", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))
