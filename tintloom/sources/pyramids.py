"""Pyramids: tiled BigTIFFs of all levels of a slide, each written by many tasks.

Compressed tiles are written once as a table beside the output. Their sizes, summed by bands (the tiles of one row of a
level) and over the bands before, say where each band stands in its file. So each task writes whole bands at places
that no other task writes, from bytes that don't change: a task that is killed or runs twice leaves the same bytes. Last,
a small job takes the places of a slide's tiles, writes header and directories, compares the size with the plan, and
renames. Until then nothing stands at the file's name.

Where a file system can't write at a place (object stores), each band is an object of its own, and the last job
strings them together as a stream.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import JPEG_QUALITY
from ..operators.quality import no_clock
from . import codecs, jpeg, storage
from .pixels import array_of

#: Bytes of a BigTIFF header, behind which blocks begin.
HEAD = 16
BAND = ["slide_id", "level", "ty"]
DONE = "slide_id int, file string, tiles int, seconds double, error string"


def encoder(compression: str, quality: int | None = None) -> Callable[[bytes, int, int], bytes]:
    """What makes a block of a tile's pixels (bytes, height, width)."""
    if compression == "jpeg":
        return lambda pixels, h, w: jpeg.encode(array_of(pixels, h, w), quality or JPEG_QUALITY, tables=False)
    if compression == "deflate":
        return lambda pixels, h, w: zlib.compress(pixels, 6)
    return lambda pixels, h, w: bytes(pixels)


def _about(compression: str, quality: int | None) -> dict:
    """What the directories say of all blocks."""
    if compression != "jpeg":
        return {"compression": {"deflate": 8, "none": 1}[compression]}
    return {"compression": 7, "tables": b"\xff\xd8" + jpeg.table_segments(quality or JPEG_QUALITY) + b"\xff\xd9"}


def _squeezed(levels: DataFrame, compression: str, quality: int | None, clock) -> DataFrame:
    encode = encoder(compression, quality)

    def squeeze(batches):
        for batch in batches:
            data, seconds = [], []
            for p, h, w in zip(batch.pixels, batch.h, batch.w, strict=True):
                began = time.perf_counter()
                with clock("io.encode"):
                    data.append(encode(p, h, w))
                seconds.append(time.perf_counter() - began)
            yield pd.DataFrame({"slide_id": batch.slide_id, "level": batch.level, "tx": batch.tx, "ty": batch.ty, "data": data, "seconds": seconds})

    return levels.select("slide_id", "level", "tx", "ty", "h", "w", "pixels").mapInPandas(squeeze, "slide_id int, level int, tx int, ty int, data binary, seconds double")


def _placed(blocks: DataFrame) -> DataFrame:
    """The bands with the byte at which each begins."""
    bands = blocks.groupBy(*BAND).agg(F.sum(F.octet_length("data")).alias("bytes"))
    before = Window.partitionBy("slide_id").orderBy("level", "ty").rowsBetween(Window.unboundedPreceding, -1)
    return bands.select(*BAND, (F.coalesce(F.sum("bytes").over(before), F.lit(0)) + HEAD).alias("base"))


def _write_bands(blocks: DataFrame, work: str, local: bool, clock) -> DataFrame:
    """Writes each band; rows (slide_id, level, ty, tx, offset, size, error, seconds), one for each tile."""
    rows = blocks.join(_placed(blocks), BAND).repartition(*BAND).sortWithinPartitions(*BAND, "tx")

    def write(batches):
        key = out = at = None
        error = None
        try:
            for batch in batches:
                done = []
                for r in batch.itertuples(index=False):
                    began = time.perf_counter()
                    with clock("io.save"):
                        if (r.slide_id, r.level, r.ty) != key:
                            if out:
                                out.close()
                            key, at, out, error = (r.slide_id, r.level, r.ty), r.base, None, None
                        offset, at = at, at + len(r.data)
                        if error is None:
                            try:
                                if local:
                                    storage.write_at(f"{work}/{r.slide_id}.part", [(offset, r.data)])
                                else:
                                    out = out or storage.open_output(f"{work}/{r.slide_id}/{r.base}")
                                    out.write(r.data)
                            except Exception as e:
                                error = str(e) or type(e).__name__
                    done.append((*key, r.tx, offset, len(r.data), error, r.seconds + time.perf_counter() - began))
                yield pd.DataFrame(done, columns=["slide_id", "level", "ty", "tx", "offset", "size", "error", "seconds"])
        finally:
            if out:
                out.close()

    return rows.select(*BAND, "tx", "base", "data", "seconds").mapInPandas(write, "slide_id int, level int, ty int, tx int, offset long, size long, error string, seconds double")


def _assemble(part: str, work: str, slide: int, bases: list[int], end: int, tail: bytes) -> None:
    """A file of a header, all bands and the directories, where the bands are objects of their own."""
    with storage.open_output(part) as out:
        out.write(codecs.bigtiff_header(end))
        for base in bases:
            system, place = storage.resolve(f"{work}/{slide}/{base}")
            with system.open_input_stream(place) as f:
                while piece := f.read(8 << 20):
                    out.write(piece)
        out.write(tail)


def _finished(tiles: DataFrame, slides: DataFrame, folder: str, work: str, tile: int, about: dict, local: bool, clock) -> DataFrame:
    """Header, directories and the final name of each slide that is whole; one row a slide."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        began, info = time.perf_counter(), rows.iloc[0]
        slide, name, error = int(info.slide_id), info["name"], info.problem
        own = rows[rows.level.notna()].sort_values(["level", "ty", "tx"])
        part, images, n = f"{work}/{slide}.part", [], int((own.level == 0).sum())
        try:
            with clock("io.finish"):
                if error is None and not len(own):
                    error = "none of its tiles could be read"
                if error is None and own.error.notna().any():
                    error = own.error.dropna().iloc[0]
                for k, (w, h) in enumerate(zip(info.widths, info.heights, strict=True)):
                    here = own[own.level == k]
                    across, down = -(-w // tile), -(-h // tile)
                    want = [(ty, tx) for ty in range(down) for tx in range(across)]
                    if error is None and list(zip(here.ty.astype(int), here.tx.astype(int), strict=True)) != want:
                        error = f"level {k} has {len(here)} of {len(want)} tiles, or others than it needs"
                    images.append({"width": int(w), "height": int(h), "tile": tile, "offsets": here.offset.astype("int64").tolist(), "sizes": here["size"].astype("int64").tolist(), "resolution": float(info.resolution), "unit": int(info.unit), **about})
                if error is None:
                    end = HEAD + int(own["size"].sum())
                    tail = codecs.bigtiff_ifds(end, images)
                    target = f"{folder}/{name}"
                    if storage.size_of(part) is None and local and storage.size_of(target) == end + len(tail):
                        pass  # a run of this task before did it all
                    else:
                        if not local:
                            _assemble(part, work, slide, own.offset[own.tx == 0].astype("int64").tolist(), end, tail)
                        # end + len(tail): a run of this task before came so far
                        if storage.size_of(part) not in ((end, end + len(tail)) if local else (end + len(tail),)):
                            raise OSError(f"the blocks take {storage.size_of(part)} bytes, not {end}")
                        if local:
                            storage.write_at(part, [(0, codecs.bigtiff_header(end)), (end, tail)])
                        storage.move(part, target)
        except Exception as e:
            error = str(e) or type(e).__name__
        if error is not None:
            storage.remove(part)
        seconds = float(own.seconds.sum()) + time.perf_counter() - began
        return pd.DataFrame([(slide, name, 0 if error is not None else n, seconds, error)], columns=["slide_id", "file", "tiles", "seconds", "error"])

    rows = slides.join(tiles, "slide_id", "left")
    return rows.groupBy("slide_id").applyInPandas(finish, DONE)


def write_pyramids(levels: DataFrame, slides: DataFrame, folder: str, tile: int, compression: str = "deflate", quality: int | None = None, clock=no_clock, last=nullcontext) -> DataFrame:
    """Write one tiled BigTIFF a slide, now; rows (slide_id, file, tiles, seconds, error), one for each slide.

    levels: packed tiles of every level (slide_id, level, tx, ty, h, w, pixels) at full tile size. slides: slide_id,
    stem, and arrays by level of width and height, resolution, unit. A slide that lacks a tile or has one too many, that
    can't be written, or whose file would take the name of another slide's, is an error; it leaves no file, and the
    others are written. last: a context for the job that gives the files their names.
    """
    spark, folder = levels.sparkSession, folder.rstrip("/")
    work = f"{folder}/.tintloom-{uuid.uuid4().hex}"
    local = storage.is_local(folder)
    first = F.row_number().over(Window.partitionBy("stem").orderBy("slide_id")) == 1
    named = slides.withColumns({"name": F.concat("stem", F.lit("_norm.tiff")), "problem": F.when(~first, F.concat(F.lit("another slide of the batch is written as "), "stem", F.lit("_norm.tiff")))})
    try:
        _squeezed(levels, compression, quality, clock).write.option("compression", "none").parquet(storage.uri(f"{work}/blocks"))
        blocks = spark.read.parquet(storage.uri(f"{work}/blocks")).join(named.where("problem is null").select("slide_id"), "slide_id", "left_semi")
        _write_bands(blocks, work, local, clock).write.parquet(storage.uri(f"{work}/places"))
        places = spark.read.parquet(storage.uri(f"{work}/places"))
        with last():
            done = _finished(places, named, folder, work, tile, _about(compression, quality), local, clock).collect()  # a row a slide
    finally:
        storage.remove(work)
    return spark.createDataFrame([tuple(r) for r in done], DONE)
