"""Batches of image files: a folder in, normalized files and quality rows out.

Files are read as bytes and decoded here, so that one that can't be read, normalized or written is a row with its error,
and the others go on. An image is read, normalized, measured and written in one pass; images have no background mask,
and their source statistics are those of the whole image.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IMAGE_SUFFIXES
from ..functions.color import np_rgb_to_lab
from ..functions.names import base_name, stem, suffix
from ..operators import normalize, packed, quality, stats
from ..operators.normalize import Profile
from ..sources import codecs, sinks, storage

#: What is known of an image before and after, by kind of profile.
QC = {
    "histogram": "orig_mean double, orig_std double, norm_mean double, norm_std double, wasserstein double",
    "reinhard": "orig_mean_lab double, orig_std_lab double, norm_mean_lab double, norm_std_lab double, delta_e double",
}
ENDINGS = ("tif", "tiff", "png", "jpg", "jpeg", "bmp")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The images of a folder: path, filename, stem, content. Only files with an image's ending are read, and Spark leaves
    out those of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(storage.uri(folder)).select("path", "content")
    path = F.col("path")
    return found.where(suffix(path).isin(*IMAGE_SUFFIXES)).select("path", base_name(path).alias("filename"), stem(path).alias("stem"), "content")


def decoded(images: DataFrame, clock=quality.no_clock) -> DataFrame:
    """Whole packed images: rows (path, filename, stem, h, w, pixels, error); a file that can't be read has an error."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    with clock("io.load"):
                        image = codecs.decode_image(r.content)
                    out.append((r.path, r.filename, r.stem, *image.shape[:2], np.ascontiguousarray(image).tobytes(), None))
                except Exception as e:
                    out.append((r.path, r.filename, r.stem, None, None, None, str(e) or type(e).__name__))
            frame = pd.DataFrame(out, columns=["path", "filename", "stem", "h", "w", "pixels", "error"])
            yield frame.astype({"h": "Int32", "w": "Int32"})

    return images.select("path", "filename", "stem", "content").mapInPandas(run, "path string, filename string, stem string, h int, w int, pixels binary, error string")


def fit_images(images: DataFrame, kind: str) -> Profile:
    """The target of a batch of packed images (h, w, pixels): one distribution of all pixels, so large images weigh
    more, or the plain mean of the images' LAB moments."""

    def measure(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                image = np.frombuffer(r.pixels, np.uint8).reshape(-1, 3)
                if kind == "histogram":
                    out.append((np.concatenate([np.bincount(image[:, i], minlength=256) for i in range(3)]).tolist(), None, None))
                else:
                    lab = np_rgb_to_lab(image)
                    out.append((None, lab.mean(0).tolist(), lab.std(0).tolist()))
            yield pd.DataFrame(out, columns=["hist", "mu", "sigma"])

    found = images.where(F.col("pixels").isNotNull()).select("h", "w", "pixels").mapInPandas(measure, "hist array<long>, mu array<double>, sigma array<double>")
    if kind == "histogram":
        counts = packed.histogram_rows(found.select(F.lit(0).alias("slide_id"), "hist")).drop("slide_id")
        return normalize.cdf_profile(stats.cdf(stats.dense(counts, []), []))
    flat = found.select(*(F.get(k, F.lit(i)).alias(f"{k}_{c}") for i, c in enumerate("lab") for k in ("mu", "sigma")))
    return normalize.stats_profile(stats.mean_stats(flat, []).first())


def _channel_rows(before: np.ndarray, after: np.ndarray) -> list[tuple]:
    """Quality of each RGB channel from the counts of values before and after."""
    return _count_rows(_counts(before), _counts(after))


def _counts(image: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(image[..., i].ravel(), minlength=256) for i in range(3)])


def _count_rows(before: np.ndarray, after: np.ndarray) -> list[tuple]:
    out = []
    for ch, *both in zip("RGB", before, after, strict=True):
        row, v = [], np.arange(256)
        for n in both:
            total, s, q = int(n.sum()), int((n * v).sum()), int((n * v * v).sum())
            row += [s / total, float(np.sqrt(float(total * q - s * s))) / total]
        gap = np.abs(np.cumsum(both[0]) - np.cumsum(both[1])) / both[0].sum()
        out.append((ch, *row, float(gap.sum() / 256)))
    return out


def _lab_rows(before: np.ndarray, after: np.ndarray) -> list[tuple]:
    a, b = (np_rgb_to_lab(x).reshape(-1, 3) for x in (before, after))
    return [(ch, float(a[:, i].mean()), float(a[:, i].std()), float(b[:, i].mean()), float(b[:, i].std()), float(np.abs(b[:, i] - a[:, i]).mean())) for i, ch in enumerate("Lab")]


def normalized(images: DataFrame, profile: Profile, key: str = "path", *, folder: str | None = None, ending: str = "tif", clock=quality.no_clock) -> DataFrame:
    """Quality rows (key, ch, ..., error) of packed images, three for each, or one with its error. One narrow pass.

    With a folder the normalized image is also written there, as ``{stem}_norm.{ending}``: under a name of its own first,
    so that a task that ends early or runs twice leaves no part of a file.
    """
    function, rows_of = normalize._REGISTRY[profile.kind], _lab_rows if profile.kind == "reinhard" else _channel_rows
    columns = [c.split()[0] for c in QC["reinhard" if profile.kind == "reinhard" else "histogram"].split(", ")]
    kind = dict(images.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own = getattr(r, key)
                try:
                    if r.pixels is None:
                        raise ValueError(r.error)
                    before = np.frombuffer(r.pixels, np.uint8).reshape(int(r.h), int(r.w), 3)
                    with clock("algo.normalize"):
                        after = function(before, profile)
                    if folder is not None:
                        with clock("io.save"):
                            part = f"{folder}/.tintloom-{uuid.uuid4().hex}"
                            with storage.open_output(part) as f:
                                f.write(codecs.encode_image(after, ending))
                            try:
                                storage.move(part, f"{folder}/{r.stem}_norm.{ending}")
                            except Exception:
                                storage.remove(part)
                                raise
                    with clock("algo.measure"):
                        out += [(own, *row, None) for row in rows_of(before, after)]
                except Exception as e:
                    out.append((own, None, *[None] * len(columns), str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=[key, "ch", *columns, "error"])

    if "error" not in images.columns:
        images = images.withColumn("error", F.lit(None).cast("string"))
    schema = f"{key} {kind}, ch string, {QC['reinhard' if profile.kind == 'reinhard' else 'histogram']}, error string"
    return images.select(*dict.fromkeys([key, *(["stem"] if folder is not None else [])]), "h", "w", "pixels", "error").mapInPandas(run, schema)


# Images by parts: slides of any size, of which no task holds a whole one.


def _gathered(parts: DataFrame, measure, add, finish, schema: str) -> DataFrame:
    """What is measured of each part (numbers, always equally many), added up by slide: within tasks, then over them.

    A task sends one row for each slide it has met; ``finish`` makes the slide's rows (without its id) of the sum.
    """

    def frame(held):
        return pd.DataFrame({"slide_id": np.array(list(held), np.int32), "state": list(held.values())})

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = np.asarray(measure(r), np.float64)
                held[r.slide_id] = add(held[r.slide_id], own) if r.slide_id in held else own
            if len(held) > 1_000:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        slide = rows.slide_id.iloc[0]
        return pd.DataFrame([(slide, *row) for row in finish(reduce(add, map(np.asarray, rows.state)))])

    return parts.mapInPandas(run, "slide_id int, state array<double>").groupBy("slide_id").applyInPandas(one, f"slide_id int, {schema}")


def _moments(values: np.ndarray) -> np.ndarray:
    """Number, means, and sums of squares about the means."""
    mean = values.mean(0)
    return np.concatenate([[len(values)], mean, ((values - mean) ** 2).sum(0)])


def _with(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of values together."""
    k, n = len(a) // 2, a[0] + b[0]
    gap = b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + gap * (b[0] / n), a[k + 1 :] + b[k + 1 :] + gap * gap * (a[0] * b[0] / n)])


def _lab(r) -> np.ndarray:
    return np_rgb_to_lab(np.frombuffer(r.pixels, np.uint8).reshape(-1, 3))


def fit_parts(parts: DataFrame, kind: str) -> tuple[Profile, DataFrame]:
    """The target of a batch whose images come by parts, as ``fit_images`` has it, and each image's own statistics."""
    parts = parts.select("slide_id", "pixels")
    if kind == "histogram":
        measure = lambda r: _counts(np.frombuffer(r.pixels, np.uint8).reshape(-1, 3)).ravel()
        own = _gathered(parts, measure, np.add, lambda n: [(n.astype(np.int64).tolist(),)], "hist array<long>").persist(StorageLevel.DISK_ONLY)
        counts = packed.histogram_rows(own.select(F.lit(0).alias("slide_id"), "hist")).drop("slide_id")
        return normalize.cdf_profile(stats.cdf(stats.dense(counts, []), [])), own
    finish = lambda m: [tuple(np.stack([m[1:4], np.sqrt(m[4:] / m[0])], 1).ravel().tolist())]
    own = _gathered(parts, lambda r: _moments(_lab(r)), _with, finish, ", ".join(f"{k}_{c} double" for c in "lab" for k in ("mu", "sigma"))).persist(StorageLevel.DISK_ONLY)
    return normalize.stats_profile(stats.mean_stats(own, []).first()), own


def normalized_parts(parts: DataFrame, profile: Profile, own: DataFrame) -> DataFrame:
    """Quality rows (slide_id, ch, ...) of images that come by parts, three for each: every part is normalized by the
    statistics of its whole image. A row an image is joined to the parts, and only sums leave the tasks."""
    function = normalize._REGISTRY[profile.kind]
    image = lambda r: np.frombuffer(r.pixels, np.uint8).reshape(1, -1, 3)
    if profile.kind == "histogram":

        def measure(r):
            shares = np.asarray(r.hist).reshape(3, 256).cumsum(1)
            after = function(image(r), replace(profile, extra={"source_cdf": shares / shares[:, -1:]}))
            return np.concatenate([_counts(image(r)).ravel(), _counts(after).ravel()])

        rows = parts.select("slide_id", "pixels").join(F.broadcast(own), "slide_id")  # a row an image
        return _gathered(rows, measure, np.add, lambda n: _count_rows(*n.astype(np.int64).reshape(2, 3, 256)), f"ch string, {QC['histogram']}")

    def measure(r):
        a = _lab(r)
        b = np_rgb_to_lab(function(image(r), normalize.of_slide(profile, r))).reshape(-1, 3)
        return _moments(np.concatenate([a, b, np.abs(b - a)], 1))

    def finish(m):
        mean, dev = m[1:10].reshape(3, 3), np.sqrt(m[10:] / m[0]).reshape(3, 3)
        return [(ch, *map(float, (mean[0, i], dev[0, i], mean[1, i], dev[1, i], mean[2, i]))) for i, ch in enumerate("Lab")]

    rows = normalize.with_moments(parts.select("slide_id", "pixels"), F.broadcast(own))  # a row an image
    return _gathered(rows, measure, _with, finish, f"ch string, {QC['reinhard']}")


def run_images(spark: SparkSession, folder: str, output: str, target: Profile | str, *, ending: str = "tif", log: str | None = "", timings: quality.Timings | None = None) -> DataFrame:
    """Normalize the images of a folder; returns the quality rows (filename, channel, ..., error).

    target: a profile, or "histogram" or "reinhard" for the batch's own average. Files are written to ``output``, and so
    is a CSV of the rows, named by ``log`` or by the kind of target; None: no CSV. Two images of one stem would be one
    file: the first by path is written, the others are errors. A folder without readable images is an error.
    """
    if ending not in ENDINGS:
        raise ValueError(f"images are written as one of {', '.join(ENDINGS)}")
    timings = timings or quality.Timings()
    found = listed(spark, folder)
    first = F.row_number().over(Window.partitionBy("stem").orderBy("path")) == 1
    paths = found.select("path", "filename", "stem").withColumn("first", first)
    second = paths.where("not first")
    images = decoded(found, timings.clock)
    if isinstance(target, str):
        with timings.time("fit"):
            if not images.where("error is null").limit(1).count():
                raise RuntimeError("none of the images could be read")
            target = fit_images(images, target)
    some = images.join(second.select("path"), "path", "left_anti")
    rows = normalized(some, target, "filename", folder=output.rstrip("/"), ending=ending, clock=timings.clock).withColumnRenamed("ch", "channel")
    clash = second.select("filename", F.lit("another image of the batch is written to the same file").alias("error"))
    out = rows.unionByName(clash, allowMissingColumns=True).persist(StorageLevel.DISK_ONLY)
    with timings.time("normalize and write"):
        out.count()
    if log is not None:
        sinks.write_csv_log(out.orderBy("filename", "channel"), output, log or target.kind, datetime.datetime.now().strftime("%Y%m%d_%H%M%S"))
    return out
