"""Normalize packed tiles as they arrive in a folder, to a target that was fitted before.

Transforms are per tile and hold no state, so there is no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.normalize import Profile, normalize_tiles
from ..sources.pixels import TILES


def watch(spark: SparkSession, folder: str, profile: Profile, files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of normalized tiles from a folder of Parquet tiles."""
    tiles = spark.readStream.schema(TILES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return normalize_tiles(tiles, profile)


def start(spark: SparkSession, folder: str, output: str, checkpoint: str, profile: Profile, once: bool = False):
    """Write what ``watch`` gives as Parquet, exactly once; with ``once`` take what is there and stop."""
    writer = watch(spark, folder, profile).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
