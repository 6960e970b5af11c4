"""Whole runs: fit a target, normalize slides to it, write and log. Six modes, two kinds of output, and images."""

from __future__ import annotations

import datetime
import uuid
from contextlib import nullcontext

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MIN_VALID_TILES, REFERENCE_MODES, JobConfig
from ..functions.names import resolution, stem
from ..operators import normalize, packed, pyramid, quality, stains, stats, tissue
from ..operators.grid import sampling_grid
from ..operators.normalize import Profile
from ..sources import files, pixels as px, sinks, storage
from .progress import CANCELLED, UNSTARTED, Watch


def fit(pixels: DataFrame, slides: DataFrame, config: JobConfig, reference: int | None = None) -> Profile:
    """The target of a run from long pixels; ``reference`` names the slide that modes 1, 3, 5 and 6 take."""
    if config.mode in (1, 3, 5, 6):
        pixels, slides = (d.where(F.col("slide_id") == reference) for d in (pixels, slides))
    args = (pixels, slides, config.slide_type, config.tile_size)
    if config.mode == 1:
        return normalize.cdf_profile(stats.slide_cdf(*args))
    if config.mode == 2:
        return normalize.cdf_profile(stats.slide_weighted_cdf(stats.slide_cdf(*args)))
    if config.mode == 3:
        return normalize.stats_profile(stats.slide_lab_stats(*args).first())
    if config.mode == 4:
        return normalize.stats_profile(stats.mean_stats(stats.slide_lab_stats(*args), []).first())
    tiles, under = stats.sample(*args)
    return stain_target(stats.used_colours(tiles, under, config.tile_size), config)


def stain_target(colours: DataFrame, config: JobConfig) -> Profile:
    """The stains of the reference's colours (slide_id, r, g, b, times), which are one slide's."""
    if config.mode == 5:
        return normalize.stain_profile("macenko", stains.fit_macenko_colours(colours, config.orientation))
    return normalize.stain_profile("vahadane", stains.fit_vahadane_colours(colours))


def transform(pixels: DataFrame, profile: Profile, source: DataFrame | None = None) -> DataFrame:
    """Long pixels with r2, g2, b2: each tile normalized, its background white."""
    return normalize.keep_background(normalize.apply(pixels, profile, source))


def fit_packed(tiles: DataFrame, slides: DataFrame, config: JobConfig, reference: int | None = None) -> Profile:
    """The same target from packed tiles; only the tiles that a sampled window meets are shuffled."""
    if config.mode in REFERENCE_MODES:
        tiles, slides = (d.where(F.col("slide_id") == reference) for d in (tiles, slides))
    windows = packed.cut_windows(tiles, sampling_grid(slides, config.slide_type, config.tile_size), config.tile_size)
    scored = score_windows(windows, config).persist()
    try:
        return fit_windows(windows, scored, config)
    finally:
        scored.unpersist()


def score_windows(windows: DataFrame, config: JobConfig) -> DataFrame:
    """Statistics of each sampled window, and which are used (``used``, ``valid_count``, ``total_count``, ``fallback``)."""
    valid = tissue.biopsy_valid if config.slide_type == "biopsy" else tissue.tma_valid
    return tissue.with_fallback(valid(packed.window_stats(windows)))


def window_moments(scored: DataFrame) -> DataFrame:
    """LAB moments by slide: the means of those of its used windows."""
    flat = scored.where("used").select("slide_id", *(F.get(k, F.lit(i)).alias(f"{k}_{c}") for i, c in enumerate("lab") for k in ("mu", "sigma")))
    return stats.mean_stats(flat, ["slide_id"])


def fit_windows(windows: DataFrame, scored: DataFrame, config: JobConfig) -> Profile:
    """The target from sampled windows and their scores; by a registered method of one's own if the settings name it."""
    if config.own:
        used = windows.join(scored.where("used").select("slide_id", "seq"), ["slide_id", "seq"])
        return normalize.fit_method(used, normalize.METHODS[config.own])
    if config.mode in (1, 2):
        cdfs = stats.cdf(packed.histogram_rows(scored.where("used")), ["slide_id"])
        return normalize.cdf_profile(cdfs if config.mode == 1 else stats.slide_weighted_cdf(cdfs))
    if config.mode in (3, 4):
        return normalize.stats_profile(stats.mean_stats(window_moments(scored), []).first())
    used = windows.join(scored.where("used").select("slide_id", "seq"), ["slide_id", "seq"])
    return stain_target(packed.colours(used), config)


def stain_fields(profile: Profile) -> dict:
    if profile.stains is None:
        return {}
    return {f"stain_{k}_{c}": round(float(profile.stains[i][j]), 5) for i, k in enumerate("HE") for j, c in enumerate("rgb")}


def log_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A log with the fixed columns, whatever keys the rows have."""
    names = [c.split()[0] for c in sinks.LOG_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], sinks.LOG_COLUMNS)


def with_levels(tiles: DataFrame, slides: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Normalized level-0 tiles with the reduced levels, each from level 0; and the sizes of all levels.

    A tile is reduced where it is whenever the factor divides the tile size; its small pieces meet in one group a target tile.
    """
    factors = pyramid.levels(slides, tile)
    steps = factors.select("slide_id", "level", "factor")

    def shrink(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                image = px.array_of(r.pixels, r.h, r.w)
                f = int(r.factor)
                if f > tile or tile % f:
                    raise ValueError(f"tile size {tile} can't be reduced by {f}")
                # only what the slide covers counts in a block's mean
                seen = np.zeros(image.shape[:2], np.int64)
                seen[: max(0, min(r.h, r.height - r.ty * tile)), : max(0, min(r.w, r.width - r.tx * tile))] = 1
                block = lambda a: a.reshape(r.h // f, f, r.w // f, f).sum((1, 3))  # noqa: B023, E731
                n = block(seen)
                sums = np.stack([block(image[..., c] * seen) for c in range(3)], -1)
                small = np.where(n[..., None] > 0, (2 * sums + n[..., None]) // np.maximum(2 * n[..., None], 1), 255).astype(np.uint8)
                out.append((r.slide_id, r.level, r.tx // f, r.ty // f, (r.tx % f) * (tile // f), (r.ty % f) * (tile // f), small.shape[0], small.shape[1], small.tobytes()))
            yield pd.DataFrame(out, columns=["slide_id", "level", "tx", "ty", "dx", "dy", "h", "w", "pixels"])

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        full = np.full((tile, tile, 3), 255, np.uint8)
        for r in rows.itertuples(index=False):
            full[r.dy : r.dy + r.h, r.dx : r.dx + r.w] = px.array_of(r.pixels, r.h, r.w)
        return pd.DataFrame({"slide_id": [rows.slide_id.iloc[0]], "level": [rows.level.iloc[0]], "tx": [rows.tx.iloc[0]], "ty": [rows.ty.iloc[0]], "h": [tile], "w": [tile], "pixels": [full.tobytes()]})

    joined = tiles.join(steps, "slide_id").join(slides.select("slide_id", "width", "height"), "slide_id")
    small = joined.select("slide_id", "tx", "ty", "h", "w", "pixels", "level", "factor", "width", "height").mapInPandas(shrink, "slide_id int, level int, tx int, ty int, dx int, dy int, h int, w int, pixels binary")
    reduced = small.groupBy("slide_id", "level", "tx", "ty").applyInPandas(assemble, "slide_id int, level int, tx int, ty int, h int, w int, pixels binary")
    top = tiles.select("slide_id", F.lit(0).alias("level"), "tx", "ty", "h", "w", "pixels")
    sizes = factors.select("slide_id", "level", "w", "h").unionByName(slides.select("slide_id", F.lit(0).alias("level"), F.col("width").alias("w"), F.col("height").alias("h")))
    ordered = F.array_sort(F.collect_list(F.struct("level", "w", "h")))
    arrays = sizes.groupBy("slide_id").agg(F.transform(ordered, lambda s: s["w"]).alias("widths"), F.transform(ordered, lambda s: s["h"]).alias("heights"))
    return top.unionByName(reduced), arrays


def run(spark: SparkSession, config: JobConfig, paths: list[str], timings: quality.Timings | None = None, watch: Watch | None = None) -> DataFrame:
    """A whole batch over slide files; returns the run log.

    A slide whose header, a sampled window or any tile can't be read, that can't be normalized or written, or whose
    output would take the name of another's, becomes an error row and leaves no file; the others go on. Of these, a slide
    with a bad header or window has no part in batch averages. (A tile that only turns out to be bad as it is
    normalized fails its slide then: every block of a slide is decoded once for that, and the blocks under its sampled
    windows once more, before.) A reference that can't be sampled ends the run. timings: gets the seconds of the
    driver's steps and of reading, normalizing and writing within tasks. watch: progress, and cancelling from another
    thread: slides under way are rows of error "cancelled" that took no time, later ones "not started".
    """
    timings = timings or quality.Timings()
    if watch is not None:
        with watch.jobs(f"normalize {len(paths)} slides"):
            return _run(spark, config, paths, timings, watch)
    return _run(spark, config, paths, timings, None)


def _waves(slides: DataFrame, watch: Watch | None, write) -> list[dict]:
    """Log rows of all slides; wave by wave where a watch is given."""
    if watch is None:
        return write(slides)
    ids = sorted(r["slide_id"] for r in slides.select("slide_id").collect())  # a row a slide
    done: list[dict] = []
    watch.total = len(ids)
    for k in range(0, len(ids), watch.wave):
        wave = ids[k : k + watch.wave]
        if watch.cancelled:
            done += [{"slide_id": i, "error": UNSTARTED} for i in ids[k:]]
            break
        try:
            done += write(slides.where(F.col("slide_id").isin(wave)))  # as many as a wave has
            watch.done += len(wave)
        except Exception:
            if not watch.cancelled:
                raise
            done += [{"slide_id": i, "error": CANCELLED, "elapsed_s": 0.0} for i in wave]
    return done


def _run(spark: SparkSession, config: JobConfig, paths: list[str], timings: quality.Timings, watch: Watch | None) -> DataFrame:
    """See ``run``."""
    # a reference outside the batch is read but not normalized
    every = list(dict.fromkeys([*paths, *([config.ref_path] if config.ref_path else [])]))
    problems = config.problems(len(paths), exists=lambda p: p in every)
    if config.own and config.own not in normalize.METHODS:
        problems.append(f"no method {config.own} is registered")
    if problems:
        raise ValueError("; ".join(problems))
    by_reference, wanted = config.mode in REFERENCE_MODES, set(paths)
    ids = spark.createDataFrame([(i, p, p in wanted, p == config.ref_path) for i, p in enumerate(every)], "slide_id int, path string, own boolean, reference boolean")
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.DISK_ONLY))
        return held[-1]

    try:
        with timings.time("headers"):
            headers = keep(ids.join(files.slide_headers(ids), "path").withColumn("stem", stem(F.col("path"))))
            readable = tissue.readable(headers)
        # the windows that the target and the slides' own statistics are taken from
        both = F.col("reference") if config.mode in (1, 5, 6) else F.col("reference") | F.col("own") if config.mode == 3 else F.col("own")
        sampled = readable.where(both)
        places = sampling_grid(sampled, config.slide_type, config.tile_size).join(sampled.select("slide_id", "path"), "slide_id")
        windows = files.read_windows(places, config.tile_size, timings.clock)
        seen = keep(packed.window_stats(windows, timings.clock))
        bad = seen.where("error is not null").groupBy("slide_id").agg(F.min("error").alias("error"))
        valid = tissue.biopsy_valid if config.slide_type == "biopsy" else tissue.tma_valid
        scored = keep(tissue.with_fallback(valid(seen.join(bad.select("slide_id"), "slide_id", "left_anti"))))
        problem = headers.where("error is not null").select("slide_id", "error").unionByName(bad)
        if by_reference and (failed := problem.join(headers.where("reference").select("slide_id"), "slide_id").first()):
            raise RuntimeError(f"the reference slide can't be read: {failed['error']}")
        mine = readable.where("own").join(bad.select("slide_id"), "slide_id", "left_anti")
        done: list[dict] = []
        if mine.limit(1).count():
            of_target = scored.join(headers.where("reference" if by_reference else "own").select("slide_id"), "slide_id")
            with timings.time("fit"):
                profile = fit_windows(windows, of_target, config)
            moments = window_moments(scored) if config.source_scope == "slide" else None
            with timings.time("normalize and write"):
                write = _write_tiles if config.output_format == "tiles" else _write_slides
                done = _waves(mine, watch, lambda some: write(some, profile, config, moments, timings.clock, watch))
            if config.mode in (3, 4) and config.output_format == "wsi":
                done = _with_sample_counts(done, scored)
        elif config.mode in (2, 4):
            raise RuntimeError("no slide of the batch can be read")
        done += [r.asDict() for r in problem.join(headers.where("own").select("slide_id"), "slide_id").collect()]  # a row a failed slide
    finally:
        for df in held:
            df.unpersist()
    name_of = lambda r: r.get("filename") or every[r["slide_id"]].rsplit("/", 1)[-1]
    rows = []
    for r in done:
        if r.get("error") is None:
            rows.append({"method": config.method, **r})
        else:
            stopped = r["error"] in (CANCELLED, UNSTARTED)  # these have no method
            rows.append({"method": None if stopped else config.method, "filename": name_of({"slide_id": r["slide_id"]}), "error": r["error"], "elapsed_s": r.get("elapsed_s") if stopped else None})
    log = log_rows(spark, rows)
    if config.save_log:
        now = datetime.datetime.now()
        sinks.write_run_log(log, config, now.strftime("%Y-%m-%d %H:%M:%S"), now.strftime("%Y%m%d_%H%M%S"))
    return log


def _write_tiles(slides: DataFrame, profile: Profile, config: JobConfig, moments: DataFrame | None, clock, watch: Watch | None = None) -> list[dict]:
    """Rows of the log of PNG tiles, one a slide. Tiles get their final names once all of their slide were read."""
    first = F.row_number().over(Window.partitionBy("stem").orderBy("slide_id")) == 1
    ranked = slides.select("slide_id", "path", "stem", "height", first.alias("first"))
    same = ranked.where("not first").select("slide_id", F.concat(F.lit("another slide of the batch is written to the folder "), "stem").alias("error"))
    some = ranked.where("first")
    work = f"{config.output_dir.rstrip('/')}/.tintloom-{uuid.uuid4().hex}"
    tiles = files.tiles_of(some, config.tile_size, clock)
    manifest = sinks.write_png_tiles(tiles, some, profile, work, moments=moments, clock=clock).persist(StorageLevel.DISK_ONLY)
    try:
        bad = manifest.where("unreadable").groupBy("slide_id").agg(F.min("error").alias("error"))
        good = manifest.join(bad.select("slide_id"), "slide_id", "left_anti")
        lost = sinks.move_png_tiles(good, some, work, config.output_dir).where("error is not null").groupBy("slide_id").agg(F.min("error").alias("error"))
        manifest.count()
        with watch.spared() if watch else nullcontext():
            errors = [r.asDict() for r in lost.unionByName(bad).unionByName(same).collect()]  # a row a failed slide
        rows = sinks.tile_counts(good, config.tile_size).join(good.groupBy("slide_id").agg(F.round(F.sum("seconds"), 4).alias("elapsed_s")), "slide_id")
        failed = {r["slide_id"] for r in errors}
        counts = [r for r in rows.join(some.select("slide_id", "stem"), "slide_id").collect() if r["slide_id"] not in failed]
    finally:
        manifest.unpersist()
        storage.remove(work)
    return [{"slide_id": r["slide_id"], "filename": r["stem"], **{k: r[k] for k in ("tiles_total", "tiles_saved", "tiles_skipped", "elapsed_s")}} for r in counts] + errors


def _write_slides(slides: DataFrame, profile: Profile, config: JobConfig, moments: DataFrame | None, clock, watch: Watch | None = None) -> list[dict]:
    """Rows of the log of pyramids, one a slide; elapsed_s is the work on a slide's own tiles and file."""
    # read and normalized once; kept on the executors' disks, since level 0 and the reduced levels both take it
    tiles = files.tiles_of(slides, config.tile_size, clock)
    made = normalize.normalize_tiles(tiles, profile, pad_to=config.tile_size, keep_errors=True, moments=moments, clock=clock).persist(StorageLevel.DISK_ONLY)
    try:
        spent = made.groupBy("slide_id").agg(F.sum("seconds").alias("seconds"), F.min("error").alias("error"))
        spent = {r["slide_id"]: r for r in spent.collect()}  # a row a slide
        bad = made.where("error is not null").select("slide_id").distinct()
        fine, some = (d.join(bad, "slide_id", "left_anti") for d in (made, slides))
        levels, sizes = with_levels(fine.drop("seconds", "error"), some, config.tile_size)
        per_cm, unit = resolution(F.when(F.col("mpp") != "unknown", F.col("mpp")))
        about = some.join(sizes, "slide_id").select("slide_id", "stem", "widths", "heights", per_cm.alias("resolution"), unit.alias("unit"))
        rows = sinks.write_pyramids(levels, about, config.output_dir, config.tile_size, config.compression, config.jpeg_quality, clock, watch.spared if watch else nullcontext).collect()
    finally:
        made.unpersist()
    time_of = lambda r: round(r["seconds"] + (spent[r["slide_id"]]["seconds"] if r["slide_id"] in spent else 0.0), 4)
    done = [{"slide_id": r["slide_id"], "filename": r["file"], "tiles_total": r["tiles"], "elapsed_s": time_of(r), "error": r["error"], **stain_fields(profile)} for r in rows]
    return done + [{"slide_id": i, "error": r["error"]} for i, r in spent.items() if r["error"] is not None]


def _with_sample_counts(done: list[dict], scored: DataFrame) -> list[dict]:
    """The log of LAB runs also tells how many sampled tiles counted."""
    counts = scored.groupBy("slide_id").agg(F.first("valid_count").alias("valid_tiles"), F.first("total_count").alias("total_tiles_sampled"), F.first("fallback").alias("fallback"))
    found = {r["slide_id"]: r.asDict() for r in counts.collect()}  # a row a slide
    return [{**r, **found.get(r["slide_id"], {})} for r in done]


def image_batch(pixels: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Whole images in long form, one ``slide_id`` each: the normalized pixels and the quality rows by channel.

    Images have no background mask; the source statistics are those of the whole image.
    """
    out = normalize.apply(pixels, profile, by=["slide_id"])
    return out, quality.lab_qc(out, ["slide_id"]) if profile.kind == "reinhard" else quality.channel_qc(out, ["slide_id"])


def normalize_images(images: DataFrame, profile: Profile) -> DataFrame:
    """Whole packed images (path, h, w, pixels), normalized without a background mask. One narrow pass."""
    function = normalize._REGISTRY[profile.kind]

    def go(batches):
        for batch in batches:
            yield batch.assign(pixels=[function(px.array_of(p, h, w), profile).tobytes() for p, h, w in zip(batch.pixels, batch.h, batch.w, strict=True)])

    return images.select("path", "h", "w", "pixels").mapInPandas(go, "path string, h int, w int, pixels binary")


__all__ = ["MIN_VALID_TILES", "fit", "fit_packed", "fit_windows", "image_batch", "log_rows", "normalize_images", "run", "score_windows", "transform", "with_levels"]
