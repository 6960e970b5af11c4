"""Grids as table functions, for SQL: ``SELECT * FROM slides, LATERAL sampling_grid(width, height, 512, 'biopsy')``."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..config import BIOPSY_GRID, TMA_GRID


def _axis(i: int, size: int, tile: int, n: int) -> int:
    return size - 2 * tile if i == n - 1 else math.floor(float(tile) + i * (float(size - 3 * tile) / (n - 1)))


class SamplingGrid:
    """The places of the windows sampled on a slide: ``biopsy`` from the centre outward, ``tma`` column by column."""

    def eval(self, width: int, height: int, tile: int, kind: str):
        if width is None or height is None:
            return
        n = {"biopsy": BIOPSY_GRID, "tma": TMA_GRID}[kind]
        cells = [(i, j, _axis(i, width, tile, n), _axis(j, height, tile, n)) for i in range(n) for j in range(n)]
        if kind == "biopsy":
            cells.sort(key=lambda c: ((c[2] - width / 2.0) ** 2 + (c[3] - height / 2.0) ** 2, c[0], c[1]))
        for seq, (_, _, x, y) in enumerate(cells):
            yield seq, x, y


class FullGrid:
    """All tiles of a slide in row-major order, those at the edge cropped."""

    def eval(self, width: int, height: int, tile: int):
        for ty in range(-(-(height or 0) // tile)):
            for tx in range(-(-(width or 0) // tile)):
                yield tx, ty, tx * tile, ty * tile, min(tile, width - tx * tile), min(tile, height - ty * tile)


def register(spark: SparkSession) -> None:
    """Make ``sampling_grid(width, height, tile, kind)`` and ``tile_grid(width, height, tile)`` known to SQL."""
    spark.udtf.register("sampling_grid", udtf(SamplingGrid, returnType="seq int, x int, y int"))
    spark.udtf.register("tile_grid", udtf(FullGrid, returnType="tx int, ty int, x int, y int, w int, h int"))
