"""Sinks: pyramids, PNG tiles, single images, quality and run logs. Paths may be of any file system pyarrow knows."""

from __future__ import annotations

import dataclasses
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOG_VERSION, SAVE_MIN_SCORE, WHITE_LEVEL, WHITE_SHARE
from ..operators.normalize import SOURCE, Profile, _REGISTRY, np_with_background, of_slide, with_moments
from ..operators.quality import no_clock
from . import codecs, storage
from .pixels import array_of
from .pyramids import write_pyramids

# The columns of the parameter log, in order.
LOG_COLUMNS = "filename string, tiles_total int, tiles_saved int, tiles_skipped int, valid_tiles int, total_tiles_sampled int, elapsed_s double, fallback boolean, stain_H_r double, stain_H_g double, stain_H_b double, stain_E_r double, stain_E_g double, stain_E_b double, method string, error string"


def _parent_free(folder: str) -> str:
    return folder.rstrip("/")


def write_png_tiles(tiles: DataFrame, slides: DataFrame, profile: Profile, folder: str, *, moments: DataFrame | None = None, clock=no_clock) -> DataFrame:
    """Normalize and write the tissue tiles; rows (slide_id, tx, ty, file, saved, error, unreadable, seconds), one for each tile evaluated.

    tiles: packed, with an error where one can't be read; slides: slide_id, stem. Skipped: mostly white, flat, or failing.
    """
    function, folder = _REGISTRY[profile.kind], _parent_free(folder)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                began, name, error, saved, unreadable = time.perf_counter(), None, None, False, r.pixels is None
                try:
                    if unreadable:
                        raise ValueError(r.error)
                    name = f"{r.stem}_x{int(r.tx):04d}_y{r.ty:04d}.png"
                    image = array_of(r.pixels, int(r.h), int(r.w))
                    white = (image.astype(np.int32).sum(-1) > 3 * WHITE_LEVEL).mean() >= WHITE_SHARE
                    if not (white or image.std() < SAVE_MIN_SCORE):
                        with clock("algo.normalize"):
                            made = np_with_background(image, of_slide(profile, r), function)
                        with clock("io.save"), storage.open_output(f"{folder}/{r.stem}/{name}") as f:
                            f.write(codecs.encode_png(made))
                        saved = True
                except Exception as e:  # a tile that fails is skipped, the run goes on
                    error = str(e) or type(e).__name__
                out.append((r.slide_id, r.tx, r.ty, name, saved, error, unreadable, time.perf_counter() - began))
            frame = pd.DataFrame(out, columns=["slide_id", "tx", "ty", "file", "saved", "error", "unreadable", "seconds"])
            yield frame.astype({"tx": "Int32"})

    if "error" not in tiles.columns:
        tiles = tiles.withColumn("error", F.lit(None).cast("string"))
    rows = with_moments(tiles, moments).join(F.broadcast(slides.select("slide_id", "stem")), "slide_id")  # a row a slide
    return rows.select("slide_id", "stem", "tx", "ty", "h", "w", "pixels", "error", *SOURCE).mapInPandas(run, "slide_id int, tx int, ty int, file string, saved boolean, error string, unreadable boolean, seconds double")


def move_png_tiles(manifest: DataFrame, slides: DataFrame, source: str, folder: str) -> DataFrame:
    """Give the saved tiles of slides (slide_id, stem) their final names; rows (slide_id, moved, error)."""
    source, folder = _parent_free(source), _parent_free(folder)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                error = None
                try:
                    storage.move(f"{source}/{r.stem}/{r.file}", f"{folder}/{r.stem}/{r.file}")
                except Exception as e:
                    error = str(e) or type(e).__name__
                out.append((r.slide_id, error is None, error))
            yield pd.DataFrame(out, columns=["slide_id", "moved", "error"])

    rows = manifest.where("saved").join(F.broadcast(slides.select("slide_id", "stem")), "slide_id")  # a row a slide
    return rows.select("slide_id", "stem", "file").mapInPandas(run, "slide_id int, moved boolean, error string")


def tile_counts(manifest: DataFrame, tile: int) -> DataFrame:
    """Saved, skipped and evaluated tiles of each slide, with the top-left pixels of the skipped ones."""
    place = F.when(~F.col("saved"), F.struct((F.col("tx") * tile).alias("x"), (F.col("ty") * tile).alias("y")))
    return manifest.groupBy("slide_id").agg(F.count("*").cast("int").alias("tiles_total"), F.sum(F.col("saved").cast("int")).cast("int").alias("tiles_saved"), F.sum((~F.col("saved")).cast("int")).cast("int").alias("tiles_skipped"), F.array_sort(F.collect_list(place)).alias("skipped_coords"))


def write_images(images: DataFrame, folder: str, ending: str = "tif") -> DataFrame:
    """Write whole packed images (path, h, w, pixels) as ``{stem}_norm.{ending}``: tif, tiff, png, jpg, jpeg or bmp."""
    folder = _parent_free(folder)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                stem = r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                error = None
                try:
                    with storage.open_output(f"{folder}/{stem}_norm.{ending}") as f:
                        f.write(codecs.encode_image(array_of(r.pixels, r.h, r.w), ending))
                except Exception as e:
                    error = str(e)
                out.append((r.path, f"{stem}_norm.{ending}", error))
            yield pd.DataFrame(out, columns=["path", "file", "error"])

    return images.select("path", "h", "w", "pixels").mapInPandas(run, "path string, file string, error string")


def write_csv_log(log: DataFrame, folder: str, mode: str, stamp: str) -> str | None:
    """One CSV with a header; none if the log is empty. The log has a row a slide or image, so one task writes it."""
    if not log.limit(1).count():
        return None
    place = f"{_parent_free(folder)}/normlog_{mode.replace(' ', '_').replace('–', '-')}_{stamp}"
    log.drop("skipped_coords").coalesce(1).write.option("header", True).mode("overwrite").csv(place)
    return place


def run_summary(log: DataFrame) -> DataFrame:
    """Slides, completed, errors, and saved and skipped tiles of the rows without error."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(c)
    return log.agg(F.count("*").alias("slides"), F.sum(good.cast("int")).alias("completed"), F.sum((~good).cast("int")).alias("errors"), total("tiles_saved"), total("tiles_skipped"))


def render_run_log(rows: list[dict], config, when: str) -> str:
    """A report in Markdown: the settings, the target's stains, a table of the log's columns that have values, errors, totals."""
    used = [c.split()[0] for c in LOG_COLUMNS.split(", ")]
    good, bad = [r for r in rows if r.get("error") is None], [r for r in rows if r.get("error") is not None]
    columns = [c for c in used if not c.startswith("stain_") and c not in ("method", "error") and any(r.get(c) is not None for r in good)]
    settings = {"finished": when, "report version": LOG_VERSION, "mode": f"{config.mode} ({config.method})"}
    settings |= {f.name.replace("_", " "): getattr(config, f.name) for f in dataclasses.fields(config) if f.name != "mode" and getattr(config, f.name) is not None}
    parts = [["# Normalized slides"], [f"- {k}: {v}" for k, v in settings.items()]]
    stains = {c: good[0][c] for c in used if c.startswith("stain_") and good and good[0].get(c) is not None}
    if stains:
        parts.append(["## Target", *(f"- {c}: {v}" for c, v in stains.items())])
    if good:
        table = [columns, ["-"] * len(columns), *(["" if r.get(c) is None else str(r[c]) for c in columns] for r in good)]
        parts.append(["## Slides", *(f"| {' | '.join(cells)} |" for cells in table)])
    if bad:
        parts.append(["## Failed", *(f"- {r.get('filename')}: {r['error']}" for r in bad)])
    parts.append([f"{len(good)} of {len(rows)} slides were written, {len(bad)} failed."])
    return "\n\n".join("\n".join(p) for p in parts) + "\n"


def write_run_log(log: DataFrame, config, when: str, stamp: str) -> list[str]:
    """The readable log and the parameter log of a run; nothing if the log is empty."""
    rows = [r.asDict() for r in log.orderBy("filename").collect()]  # a row a slide
    if not rows:
        return []
    name = config.method.replace(" ", "_").replace("–", "-")
    text = f"{_parent_free(config.output_dir)}/run_log_{name}_{stamp}.md"
    with storage.open_output(text) as f:
        f.write(render_run_log(rows, config, when).encode())
    return [text, write_csv_log(log, config.output_dir, name, stamp)]


__all__ = ["LOG_COLUMNS", "move_png_tiles", "render_run_log", "run_summary", "tile_counts", "write_csv_log", "write_images", "write_png_tiles", "write_pyramids", "write_run_log"]
