"""What a run reads, writes and loses: pushed filters, levels, one decode of each block, files that can't be written."""

import glob
import os
import shutil

import numpy as np
import pytest

from tintloom.config import JobConfig
from tintloom.operators import grid, normalize, quality, stats
from tintloom.plans import pipeline
from tintloom.sources import codecs, files, pixels as px, pyramids, sinks, storage

from .fixtures import frame, stained

T = 16
PLACES = "slide_id int, level int, ty int, tx int, offset long, size long, error string, seconds double"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    for i, shape in enumerate([(70, 81), (64, 64), (55, 90)]):
        (d / f"s{i}.tif").write_bytes(codecs.encode_tiff(stained(*shape, seed=i)))
    return d


def pyramid(spark, path, image, tile=T):
    """A pyramid of one image, unnormalized."""
    h, w = image.shape[:2]
    rows = []
    for level, factor in ((0, 1), (1, 2)):
        small = image[::factor, ::factor]
        for ty in range(-(-small.shape[0] // tile)):
            for tx in range(-(-small.shape[1] // tile)):
                full = np.full((tile, tile, 3), 255, np.uint8)
                cut = small[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                full[: cut.shape[0], : cut.shape[1]] = cut
                rows.append((0, level, tx, ty, tile, tile, full.tobytes()))
    levels = spark.createDataFrame(rows, "slide_id int, level int, tx int, ty int, h int, w int, pixels binary")
    slides = spark.createDataFrame([(0, "p", [w, -(-w // 2)], [h, -(-h // 2)], 40000.0, 3)], "slide_id int, stem string, widths array<int>, heights array<int>, resolution double, unit int")
    assert sinks.write_pyramids(levels, slides, str(path), tile).first()["error"] is None
    return str(path / "p_norm.tiff")


def rebuilt(rows, h, w, tile=T):
    out = np.zeros((h, w, 3), np.uint8)
    for r in rows:
        out[r["ty"] * tile : r["ty"] * tile + r["h"], r["tx"] * tile : r["tx"] * tile + r["w"]] = px.array_of(r["pixels"], r["h"], r["w"])
    return out


def test_levels_and_filters_reach_the_source(spark, tmp_path):
    image = stained(100, 75, seed=9)
    path = pyramid(spark, tmp_path, image)
    assert (rebuilt(files.read_tiles(spark, [path], T, level=0).collect(), 100, 75) == image).all()
    assert (rebuilt(files.read_tiles(spark, [path], T, level=1).collect(), 50, 38) == image[::2, ::2]).all()
    every = files.read_tiles(spark, [path], T, level="all")
    assert {(r["level"], r["n"]) for r in every.groupBy("level").count().withColumnRenamed("count", "n").collect()} == {(0, 7 * 5), (1, 4 * 3)}
    some = every.where("level = 0 and ty between 2 and 3 and tx in (1, 4)")
    assert some.rdd.getNumPartitions() == 2  # rows of tiles, of 11
    assert {(r["tx"], r["ty"]) for r in some.collect()} == {(1, 2), (4, 2), (1, 3), (4, 3)}
    assert every.where("path = 'other'").rdd.getNumPartitions() <= 1 and every.where("path = 'other'").count() == 0
    assert files.read_tiles(spark, [path], T, level=5).first()["error"]


def test_only_the_blocks_under_windows_are_read(spark, tmp_path):
    """All other blocks of the pyramid are broken, and the target is the same."""
    image = stained(400, 300, seed=3)
    path = pyramid(spark, tmp_path, image)
    data = bytearray(open(path, "rb").read())
    top = codecs.read_tiff_directories(files.reader(path))[0]
    slides = spark.createDataFrame([(0, path, 300, 400)], "slide_id int, path string, width int, height int")
    places = grid.sampling_grid(slides, "biopsy", T)
    met = {(x // T + i, y // T + j) for _, _, x, y in places.collect() for i in (0, 1) for j in (0, 1)}
    across, broken = -(-300 // T), 0
    for k, at in enumerate(top[codecs.TILES]):
        if (k % across, k // across) not in met:
            data[at : at + 8] = b"\xff" * 8
            broken += 1
    assert broken > 200
    (tmp_path / "bad.tiff").write_bytes(bytes(data))
    config = JobConfig(mode=1, output_dir=str(tmp_path), tile_size=T)
    found = []
    for p in (path, str(tmp_path / "bad.tiff")):
        windows = files.read_windows(places.withColumn("path", px.F.lit(p)), T)
        assert windows.where("error is not null").count() == 0
        found.append(pipeline.fit_windows(windows, pipeline.score_windows(windows, config), config))
    tiles = files.read_tiles(spark, [path], T).selectExpr("0 slide_id", "tx", "ty", "h", "w", "pixels")
    found.append(pipeline.fit_packed(tiles, slides, config, 0))
    assert all((f.cdf == found[0].cdf).all() for f in found)


def test_each_block_is_decoded_once_and_workers_are_timed(spark, folder, tmp_path):
    timings = quality.Timings(spark)
    config = JobConfig(mode=4, output_dir=str(tmp_path), tile_size=T, save_log=False)
    pipeline.run(spark, config, [str(folder / "s0.tif"), str(folder / "s1.tif")], timings).collect()
    calls = {k: v[0] for k, v in timings.tasks.items()}
    assert calls["io.load"] == 5 + 4  # rows of tiles of both slides, once
    assert calls["io.load_window"] == calls["algo.sample"] == 2 * 49
    assert calls["algo.normalize"] == 30 + 16 and calls["io.encode"] == calls["io.save"] == 30 + 16 + 9 + 4
    assert all(0 < longest <= total for _, total, longest in timings.tasks.values())
    rows = {r["label"]: r for r in timings.summary(spark).collect()}
    assert rows["fit"]["calls"] == 1 and rows["io.load"]["calls"] == 9 and "io.load" in timings.report(spark)
    timings.clear()
    assert timings.report(spark) == "No timings recorded."


def test_a_stain_fit_reads_its_windows_twice(spark, folder, tmp_path):
    """Once to score them, and once for the colours of those that are used."""
    timings = quality.Timings(spark)
    config = JobConfig(mode=5, output_dir=str(tmp_path), ref_path=str(folder / "s2.tif"), tile_size=T, save_log=False)
    pipeline.run(spark, config, [str(folder / "s1.tif")], timings).collect()
    assert timings.tasks["io.load_window"][0] == 2 * 49 and timings.tasks["io.load"][0] == 4


def test_slides_of_one_name_and_files_that_cant_be_written(spark, folder, tmp_path):
    for d in "ab":
        os.makedirs(tmp_path / d)
    shutil.copy(folder / "s0.tif", tmp_path / "a" / "s.tif")
    shutil.copy(folder / "s1.tif", tmp_path / "b" / "s.tif")
    os.makedirs(tmp_path / "out" / "s2_norm.tiff" / "x")
    paths = [str(tmp_path / "a" / "s.tif"), str(tmp_path / "b" / "s.tif"), str(folder / "s1.tif"), str(folder / "s2.tif")]
    log = pipeline.run(spark, JobConfig(mode=2, output_dir=str(tmp_path / "out"), tile_size=T), paths).collect()
    good = {r["filename"]: r["tiles_total"] for r in log if r["error"] is None}
    assert good == {"s_norm.tiff": 30, "s1_norm.tiff": 16}
    errors = sorted((r["filename"], r["error"]) for r in log if r["error"] is not None)
    assert [f for f, _ in errors] == ["s.tif", "s2.tif"] and "another slide" in errors[0][1] and "folder" in errors[1][1]
    assert len(rebuilt(files.read_tiles(spark, [str(tmp_path / "out" / "s_norm.tiff")], T).collect(), 70, 81)) == 70
    assert sorted(os.listdir(tmp_path / "out" / "s2_norm.tiff")) == ["x"] and not glob.glob(str(tmp_path / "out" / ".tintloom*"))
    log = pipeline.run(spark, JobConfig(mode=2, output_dir=str(tmp_path / "png"), tile_size=T, output_format="tiles"), paths[:2]).collect()
    assert sorted((r["filename"], r["error"] is None) for r in log) == [("s", True), ("s.tif", False)]
    assert sum(r["tiles_saved"] for r in log if r["error"] is None) == len(glob.glob(str(tmp_path / "png" / "s" / "*.png")))


def parts(spark, tmp_path):
    """Blocks of one small level, the plan of them, and the slide's row."""
    blocks = spark.createDataFrame([(0, 0, x, y, bytes([x + 1]) * (5 + x + y), 0.0) for x in range(2) for y in range(2)], "slide_id int, level int, tx int, ty int, data binary, seconds double")
    slides = spark.createDataFrame([(0, "s_norm.tiff", None, [30], [30], 1.0, 3)], "slide_id int, name string, problem string, widths array<int>, heights array<int>, resolution double, unit int")
    return blocks, slides


@pytest.mark.parametrize("local", [True, False])
def test_bands_may_be_written_twice(spark, tmp_path, local):
    blocks, slides = parts(spark, tmp_path)
    work = str(tmp_path / "work")
    clock = quality.no_clock
    for _ in range(2):  # as a task that runs again would
        places = spark.createDataFrame(pyramids._write_bands(blocks, work, local, clock).collect(), PLACES)
    assert [(r["ty"], r["tx"], r["offset"], r["size"]) for r in places.orderBy("offset").collect()] == [(0, 0, 16, 5), (0, 1, 21, 6), (1, 0, 27, 6), (1, 1, 33, 7)]
    for _ in range(2 if local else 1):
        done = pyramids._finished(places, slides, str(tmp_path), work, T, {"compression": 1}, local, clock).collect()
        assert [(r["file"], r["tiles"], r["error"]) for r in done] == [("s_norm.tiff", 4, None)]
    read = files.reader(str(tmp_path / "s_norm.tiff"))
    top = codecs.read_tiff_directories(read)[0]
    assert [read(a, n) for a, n in zip(top[codecs.TILES], top[codecs.TILE_BYTES], strict=True)] == [b"\1" * 5, b"\2" * 6, b"\1" * 6, b"\2" * 7]


def test_a_file_that_differs_from_its_plan_is_an_error(spark, tmp_path):
    blocks, slides = parts(spark, tmp_path)
    work = str(tmp_path / "work")
    places = spark.createDataFrame(pyramids._write_bands(blocks, work, True, quality.no_clock).collect(), PLACES)
    storage.write_at(f"{work}/0.part", [(60, b"more")])
    row = pyramids._finished(places, slides, str(tmp_path), work, T, {"compression": 1}, True, quality.no_clock).first()
    assert "not 40" in row["error"] and not glob.glob(str(tmp_path / "*.tiff")) and not glob.glob(f"{work}/*.part")


def test_no_task_gets_all_tiles_of_a_slide(spark, tmp_path):
    rows = [(0, 0, x, y, bytes(9), 0.0) for x in range(8) for y in range(40)]
    blocks = spark.createDataFrame(rows, "slide_id int, level int, tx int, ty int, data binary, seconds double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = pyramids._write_bands(blocks, str(tmp_path), True, quality.no_clock)
        counts = done.groupBy(px.F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) > 2 and max(r["count"] for r in counts) < 320 / 2


@pytest.mark.parametrize("mode", [3, 4])
def test_statistics_of_the_whole_slide(spark, folder, tmp_path, mode):
    paths = [str(folder / "s0.tif"), str(folder / "s1.tif")]
    config = JobConfig(mode=mode, output_dir=str(tmp_path), ref_path=str(folder / "s2.tif"), tile_size=T, source_scope="slide", save_log=False)
    log = pipeline.run(spark, config, paths).collect()
    assert all(r["error"] is None and r["total_tiles_sampled"] == 49 for r in log)
    long = frame(spark, {i: stained(*shape, seed=i) for i, shape in enumerate([(70, 81), (64, 64), (55, 90)])}, T)
    slides = px.info(long)
    own = long.where("slide_id < 2") if mode == 4 else long
    profile = pipeline.fit(own, px.info(own), config, 2)
    source = stats.slide_lab_stats(long, slides, "biopsy", T)
    want = pipeline.transform(long.where("slide_id = 0"), profile, source).collect()
    out = rebuilt(files.read_tiles(spark, [str(tmp_path / "s0_norm.tiff")], T).collect(), 70, 81).astype(int)
    off = np.array([np.abs(out[r["y"], r["x"]] - [r["r2"], r["g2"], r["b2"]]).max() for r in want])
    assert off.max() <= 1 and (off > 0).mean() < 0.01  # means are summed in another order
    assert JobConfig(mode=1, output_dir="x", ref_path=paths[0], source_scope="slide").problems(1)


def test_moments_beside_tiles(spark):
    tile = stained(T, T, seed=1)
    tiles = spark.createDataFrame([(i, 0, 0, T, T, tile.tobytes()) for i in range(3)], px.TILES)
    side = spark.createDataFrame([(0, 50.0, 8.0, 1.0, 2.0, -3.0, 3.0), (1, 60.0, 9.0, 0.0, 1.0, -5.0, 2.0)], "slide_id int, mu_l double, sigma_l double, mu_a double, sigma_a double, mu_b double, sigma_b double")
    profile = normalize.Profile("reinhard", mu=np.array([60.0, 10, -8]), sigma=np.array([8.0, 3, 3]))
    out = {r["slide_id"]: bytes(r["pixels"]) for r in normalize.normalize_tiles(tiles, profile, moments=side).collect()}
    assert out[2] == normalize.np_with_background(tile, profile).tobytes() and len(set(out.values())) == 3


@pytest.fixture(scope="module")
def jpegs(tmp_path_factory):
    from tintloom.sources import jpeg

    d = tmp_path_factory.mktemp("jpegs")
    ramp = np.stack(np.meshgrid(np.arange(90), np.arange(77)), -1)
    smooth = np.stack([ramp[..., 0] * 2, ramp.sum(-1), 255 - ramp[..., 1] * 3], -1).astype(np.uint8)
    for name, image in (("noise", stained(70, 81, seed=2)), ("smooth", smooth), ("tiny", stained(3, 5, seed=1)), ("gray", np.repeat(stained(40, 40, seed=4)[..., :1], 3, axis=2))):
        for quality_, sub in ((40, True), (90, True), (90, False), (100, False)):
            (d / f"{name}-{quality_}-{int(sub)}.jpg").write_bytes(jpeg.encode(image, quality_, sub))
    return d


def test_jpegs_are_what_other_decoders_see(spark, jpegs):
    rows = files.read_images(spark, str(jpegs)).collect()
    assert len(rows) == 16
    for r in rows:
        own = codecs.decode_image(open(r["path"].removeprefix("file:"), "rb").read()).astype(int)
        other = px.array_of(r["pixels"], r["h"], r["w"]).astype(int)
        # the other decoder works in integers: a chroma sample that it rounds otherwise counts up to 1.772 times in a colour
        assert own.shape == other.shape and np.abs(own - other).max() <= 3 and np.abs(own - other).mean() < 0.06, r["path"]


def test_jpeg_streams_that_differ():
    from tintloom.sources import jpeg

    image = stained(33, 50, seed=6)
    whole = jpeg.encode(image, 90, False)
    bare = jpeg.encode(image, 90, False, tables=False)
    tables = jpeg.shared_tables(b"\xff\xd8" + jpeg.table_segments(90) + b"\xff\xd9")
    assert (jpeg.decode(bare, tables) == jpeg.decode(whole)).all() and len(bare) < len(whole) - 500
    # as RGB without a change of colours: what was luminance is red
    assert np.abs(jpeg.decode(whole, ycc=False)[..., 0] - (image @ [0.299, 0.587, 0.114])).max() < 16
    with pytest.raises(ValueError, match="codes"):
        jpeg.decode(bare)
    with pytest.raises(ValueError, match="shorter|broken"):
        jpeg.decode(whole[: len(whole) // 2])
    with pytest.raises(ValueError, match="baseline"):
        jpeg.decode(whole.replace(b"\xff\xc0", b"\xff\xc2"))
    for broken in (b"", b"\xff\xd8", b"not one"):
        with pytest.raises(ValueError):
            jpeg.decode(broken)
    assert jpeg.DCT @ jpeg.DCT.T == pytest.approx(np.eye(8)) and jpeg.ZIGZAG[[0, 1, 2, 3, 62, 63]].tolist() == [0, 1, 8, 16, 62, 63]


def with_restarts(image, quality_):
    """A stream of one unit of 8 x 8 blocks a restart interval, made of streams of each unit."""
    from tintloom.sources import jpeg

    h, w, _ = image.shape
    pieces = []
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            d = jpeg.encode(image[y : y + 8, x : x + 8], quality_, False)
            pieces.append(d[d.index(b"\xff\xda") + 14 : -2])
    d = jpeg.encode(image, quality_, False)
    head = d[: d.index(b"\xff\xda")] + b"\xff\xdd\x00\x04\x00\x01" + d[d.index(b"\xff\xda") :][:14]
    return head + b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(pieces) else b"") for k, p in enumerate(pieces)) + b"\xff\xd9"


def test_restart_intervals():
    from tintloom.sources import jpeg

    image = stained(24, 40, seed=8)
    assert (jpeg.decode(with_restarts(image, 85)) == jpeg.decode(jpeg.encode(image, 85, False))).all()


@pytest.mark.parametrize("quality_", [None, 95])
def test_pyramids_of_jpeg_blocks(spark, folder, tmp_path, quality_):
    config = JobConfig(mode=2, output_dir=str(tmp_path), tile_size=T, compression="jpeg", jpeg_quality=quality_, save_log=False)
    assert pipeline.run(spark, config, [str(folder / "s0.tif")]).first()["error"] is None
    plain = JobConfig(mode=2, output_dir=str(tmp_path / "plain"), tile_size=T, save_log=False)
    pipeline.run(spark, plain, [str(folder / "s0.tif")]).collect()
    from tintloom.sources import jpeg

    made, want = ([(r, d) for r in [files.reader(str(p / "s0_norm.tiff"))] for d in codecs.read_tiff_directories(r)] for p in (tmp_path, tmp_path / "plain"))
    assert made[0][1][codecs.COMPRESSION] == (7,) and made[0][1][codecs.PHOTOMETRIC] == (6,) and made[0][1][codecs.SUBSAMPLING] == (2, 2)
    blocks = lambda f, d: [codecs.decode_block(f(a, n), d, T, T) for a, n in zip(d[codecs.TILES], d[codecs.TILE_BYTES], strict=True)]
    for (f, d), (g, e) in zip(made, want, strict=True):
        for own, plain_block in zip(blocks(f, d), blocks(g, e), strict=True):
            assert (own == jpeg.decode(jpeg.encode(plain_block, quality_ or 80))).all()
    assert all(r["error"] is None for r in files.read_tiles(spark, [str(tmp_path / "s0_norm.tiff")], T).collect())


def test_png_filters_and_bitmaps():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    lines = b""
    for y in range(9):
        method = y % 5
        left = np.concatenate([np.zeros((1, 3), int), image[y, :-1].astype(int)])
        up = image[y - 1].astype(int) if y else np.zeros((7, 3), int)
        corner = np.concatenate([np.zeros((1, 3), int), up[:-1]])
        p = left + up - corner
        d = np.abs(np.stack([left - p, up - p, corner - p]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][method]
        lines += bytes([method]) + ((image[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (codecs.decode_image(png) == image).all()
    for ending in ("png", "bmp", "tif", "tiff"):
        assert (codecs.decode_image(codecs.encode_image(image, ending)) == image).all()
    with pytest.raises(ValueError):
        codecs.decode_image(b"what is it")


@pytest.mark.parametrize("n,k", [(1, 256), (5000, 3), (5000, 256), (60_000, 17)])
def test_lzw_both_ways(n, k):
    data = np.random.default_rng(n).integers(0, k, n, dtype=np.uint8).tobytes()
    assert codecs.unpack_lzw(codecs.pack_lzw(data)) == data
