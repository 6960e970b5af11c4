"""Files as DataFrames: discovery, slide headers and tiles of tiled TIFFs, plain images."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..config import DOCUMENTED_SUFFIXES, IMAGE_SUFFIXES, TILE_SIZE, WSI_SUFFIXES
from ..functions.names import base_name, stem, suffix
from ..operators.quality import no_clock
from . import codecs

HEADER = "path string, width int, height int, levels int, mpp string, error string"
TILE_ROWS = "path string, tx int, ty int, h int, w int, pixels binary, error string, level int"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path and length of the files in a folder, without its subfolders; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")


def with_suffix(paths: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return paths.where(suffix(F.col("path")).isin(*suffixes)).select(*paths.columns, base_name(F.col("path")).alias("name"), stem(F.col("path")).alias("stem")).orderBy("path")


def find_wsi_files(spark: SparkSession, folder: str, documented: bool = False) -> DataFrame:
    return with_suffix(listing(spark, folder), WSI_SUFFIXES + (DOCUMENTED_SUFFIXES if documented else ()))


def find_images(spark: SparkSession, folder: str) -> DataFrame:
    return with_suffix(listing(spark, folder), IMAGE_SUFFIXES)


def outputs_of(slides: DataFrame, outputs: DataFrame, ending: str = "_norm.tiff") -> DataFrame:
    """Each slide with the path of its normalized output, null if there is none yet."""
    made = outputs.where(F.col("path").endswith(ending)).select(F.regexp_replace(base_name(F.col("path")), "_norm\\.tiff$", "").alias("stem"), F.col("path").alias("output"))
    return slides.join(made, "stem", "left")


def reader(path: str):
    """read(offset, length) on any file system that pyarrow knows."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:")) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    f = system.open_input_file(place)
    return lambda offset, length: f.read_at(length, offset)


def slide_headers(paths: DataFrame) -> DataFrame:
    """Size, levels and resolution of each slide from its header; a file that can't be read has an error."""

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.path:
                try:
                    dirs = codecs.read_tiff_directories(reader(path))
                    top = dirs[0]
                    res, unit = top.get(codecs.X_RES), top.get(codecs.UNIT, (2,))[0]
                    mpp = str(10_000 * res[1] / res[0]) if res and unit == 3 and res[0] else "unknown"
                    out.append((path, int(top[codecs.WIDTH][0]), int(top[codecs.HEIGHT][0]), len(dirs), mpp, None))
                except Exception as e:  # a bad file is a row, not a failed job
                    out.append((path, None, None, None, None, str(e)))
            frame = pd.DataFrame(out, columns=["path", "width", "height", "levels", "mpp", "error"])
            yield frame.astype({"width": "Int32", "height": "Int32", "levels": "Int32"})

    return paths.select("path").mapInPandas(run, HEADER)


class _Rows(InputPartition):
    def __init__(self, path: str, level: int | None, ty: int):
        super().__init__((path, level, ty))
        self.path, self.level, self.ty = path, level, ty


#: What can be asked of a column of tiles without looking at any.
_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    IsNotNull: lambda v, f: v is not None,
}


class TileReader(DataSourceReader):
    """One partition for each row of tiles of each slide and level; edge tiles come cropped.

    ``slides`` is a JSON list of [path, height]; a height that isn't known is read from the header. ``level`` is a level
    of the pyramid, 0 if not given, or "all". Filters on path, level, ty and tx are taken up: rows of tiles that they
    rule out are no partitions, and blocks of other tiles aren't read.
    """

    def __init__(self, options):
        given = options.get("slides")
        self.slides = json.loads(given) if given else [[p, None] for p in options.get("paths", options.get("path", "")).split(";") if p]
        self.tile = int(options.get("tile", TILE_SIZE))
        level = options.get("level", "0")
        self.level = None if level == "all" else int(level)
        self.tests: dict[str, list] = {}

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", "level", "tx", "ty"):
                self.tests.setdefault(f.attribute[0], []).append(f)
            else:
                yield f

    def _wanted(self, column: str, value) -> bool:
        """As SQL has it: a null passes no test."""
        return all(value is not None and _TESTS[type(f)](value, f) for f in self.tests.get(column, ()))

    def partitions(self):
        found = []
        for path, height in self.slides:
            if not self._wanted("path", path):
                continue
            try:
                if height and self.level == 0:
                    heights = [height]
                else:
                    heights = [d[codecs.HEIGHT][0] for d in codecs.read_tiff_directories(reader(path))]
                    if self.level is not None and self.level >= len(heights):
                        raise ValueError("no such level")
                levels = range(len(heights)) if self.level is None else [self.level]
                found += [_Rows(path, k, ty) for k in levels if self._wanted("level", k) for ty in range(-(-heights[k] // self.tile)) if self._wanted("ty", ty)]
            except Exception:
                if self._wanted("level", self.level) and self._wanted("ty", -1) and self._wanted("tx", None):
                    found.append(_Rows(path, self.level, -1))
        return found

    def read(self, part):
        if part is None:  # no partitions are read as one without a name
            return
        try:
            read = reader(part.path)
            tags = codecs.read_tiff_directories(read)[part.level or 0]
            if part.ty < 0:
                raise ValueError("the header could not be read")
            width, height, t = tags[codecs.WIDTH][0], tags[codecs.HEIGHT][0], self.tile
            for tx, image in row_of_tiles(read, tags, part.ty, t, [tx for tx in range(-(-width // t)) if self._wanted("tx", tx)]):
                yield part.path, tx, part.ty, image.shape[0], image.shape[1], image.tobytes(), None, part.level
        except Exception as e:
            if self._wanted("tx", None):
                yield part.path, None, part.ty, None, None, None, str(e), part.level


def row_of_tiles(read, tags: dict, ty: int, tile: int, wanted: list[int]):
    """(tx, pixels) of the wanted tiles of a row, cropped at the edges. Neighbours are read together, so each block is decoded once."""
    width, y0, y1 = tags[codecs.WIDTH][0], ty * tile, min(tags[codecs.HEIGHT][0], (ty + 1) * tile)
    k = 0
    while k < len(wanted):
        n = 1
        while k + n < len(wanted) and wanted[k + n] == wanted[k] + n:
            n += 1
        x0 = wanted[k] * tile
        rows = codecs.read_region(read, tags, x0, y0, min(width, x0 + n * tile), y1)
        for i in range(n):
            yield wanted[k + i], np.ascontiguousarray(rows[:, i * tile : (i + 1) * tile])
        k += n


class SlideTiles(DataSource):
    """``spark.read.format("wsi").option("slides", '[["a.tiff", null]]').option("tile", 512)``, or ``paths`` parted by ";"."""

    @classmethod
    def name(cls):
        return "wsi"

    def schema(self):
        return TILE_ROWS

    def reader(self, schema):
        return TileReader(self.options)


def read_tiles(spark: SparkSession, paths: list[str], tile: int = TILE_SIZE, heights: list[int] | None = None, level: int | str = 0) -> DataFrame:
    """Tiles of slides; with ``heights``, as ``slide_headers`` has them, the driver opens no file.

    Filters reach the source (spark.sql.python.filterPushdown.enabled, which is set for the session).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideTiles)
    slides = json.dumps(list(zip(paths, heights or [None] * len(paths), strict=True)))
    return spark.read.format("wsi").option("slides", slides).option("tile", str(tile)).option("level", str(level)).load()


def _spread(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """Rows that each stand for much work, dealt to tasks by a number that isn't lowered for being few bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(1, min(n, 16 * spark.sparkContext.defaultParallelism)), *columns)


def tiles_of(slides: DataFrame, tile: int = TILE_SIZE, clock: Callable = no_clock) -> DataFrame:
    """All tiles of level 0: rows (slide_id, tx, ty, h, w, pixels, error). Each block is decoded once, but for those that
    cross rows of tiles.

    slides: slide_id, path, height. The slides are a table, so the driver lists neither them nor their rows of tiles.
    A row of tiles that can't be read is a row with its error.
    """
    lines = slides.select("slide_id", "path", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / tile).cast("int") - 1)).alias("ty"))
    n = slides.agg(F.sum(F.ceil(F.col("height") / tile))).first()[0] or 1

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                out = []
                try:
                    with clock("io.load"):
                        read = reader(r.path)
                        tags = codecs.read_tiff_directories(read)[0]
                        found = list(row_of_tiles(read, tags, r.ty, tile, list(range(-(-tags[codecs.WIDTH][0] // tile)))))
                    out = [(r.slide_id, tx, r.ty, *image.shape[:2], image.tobytes(), None) for tx, image in found]
                except Exception as e:
                    out = [(r.slide_id, None, r.ty, None, None, None, str(e) or type(e).__name__)]
                frame = pd.DataFrame(out, columns=["slide_id", "tx", "ty", "h", "w", "pixels", "error"])
                yield frame.astype({"tx": "Int32", "h": "Int32", "w": "Int32"})

    return _spread(lines, int(n), "slide_id", "ty").mapInPandas(run, "slide_id int, tx int, ty int, h int, w int, pixels binary, error string")


def read_windows(places: DataFrame, tile: int = TILE_SIZE, clock: Callable = no_clock) -> DataFrame:
    """Sampled windows of slides: rows (slide_id, seq, x, y, h, w, pixels, error), black outside the slide.

    places: slide_id, path, seq, x, y. Only the blocks that a window meets are read and decoded.
    """

    def run(batches):
        for batch in batches:
            for path, own in batch.groupby("path", sort=False):
                read = tags = failed = None
                try:
                    read = reader(path)
                    tags = codecs.read_tiff_directories(read)[0]
                except Exception as e:
                    failed = str(e) or type(e).__name__
                for r in own.itertuples(index=False):
                    full, error = np.zeros((tile, tile, 3), np.uint8), failed
                    try:
                        if failed is None:
                            with clock("io.load_window"):
                                x0, y0 = max(0, r.x), max(0, r.y)
                                x1, y1 = min(tags[codecs.WIDTH][0], r.x + tile), min(tags[codecs.HEIGHT][0], r.y + tile)
                                if x0 < x1 and y0 < y1:
                                    full[y0 - r.y : y1 - r.y, x0 - r.x : x1 - r.x] = codecs.read_region(read, tags, x0, y0, x1, y1)
                    except Exception as e:
                        error = str(e) or type(e).__name__
                    yield pd.DataFrame([(r.slide_id, r.seq, r.x, r.y, tile, tile, None if error else full.tobytes(), error)], columns=["slide_id", "seq", "x", "y", "h", "w", "pixels", "error"])

    n = places.count()
    return _spread(places.select("slide_id", "path", "seq", "x", "y"), n, "slide_id", "y").mapInPandas(run, "slide_id int, seq int, x int, y int, h int, w int, pixels binary, error string")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Whole images as packed tiles (path, h, w, pixels), their bytes turned from BGR to RGB."""
    images = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                rgb = raw[..., 2::-1] if r.nChannels >= 3 else np.repeat(raw, 3, axis=2)
                out.append((r.origin, r.height, r.width, np.ascontiguousarray(rgb).tobytes()))
            yield pd.DataFrame(out, columns=["path", "h", "w", "pixels"])

    return images.mapInPandas(run, "path string, h int, w int, pixels binary")
