import csv
import glob
import os
import struct

import numpy as np
import pytest

from tintloom.config import JobConfig
from tintloom.plans import pipeline
from tintloom.sources import codecs, files, pixels as px, sinks
from tintloom.streaming import watch

from .fixtures import stained

T = 16


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    for i, shape in enumerate([(70, 81), (64, 64), (55, 90)]):
        (d / f"s{i}.tif").write_bytes(codecs.encode_tiff(stained(*shape, seed=i)))
    (d / "broken.svs").write_bytes(b"not a slide")
    (d / "note.txt").write_text("x")
    (d / "dir.svs").mkdir()
    return d


def test_discovery(spark, folder):
    assert [r["name"] for r in files.find_wsi_files(spark, str(folder)).collect()] == ["broken.svs", "s0.tif", "s1.tif", "s2.tif"]
    assert [r["stem"] for r in files.find_images(spark, str(folder)).collect()] == ["s0", "s1", "s2"]


def test_headers_and_tiles(spark, folder):
    paths = spark.createDataFrame([(str(folder / n),) for n in ("s0.tif", "broken.svs")], "path string")
    rows = {os.path.basename(r["path"]): r for r in files.slide_headers(paths).collect()}
    assert (rows["s0.tif"]["width"], rows["s0.tif"]["height"], rows["s0.tif"]["mpp"]) == (81, 70, "unknown") and rows["broken.svs"]["error"]
    tiles = files.read_tiles(spark, [str(folder / "s0.tif"), str(folder / "broken.svs")], T).collect()
    assert sum(r["error"] is not None for r in tiles) == 1
    out = np.zeros((70, 81, 3), np.uint8)
    for r in tiles:
        if r["error"] is None:
            out[r["ty"] * T : r["ty"] * T + r["h"], r["tx"] * T : r["tx"] * T + r["w"]] = px.array_of(r["pixels"], r["h"], r["w"])
    assert (out == stained(70, 81, seed=0)).all()


def test_codecs_through_the_image_source(spark, tmp_path):
    image = stained(4, 3, 5)
    (tmp_path / "a.png").write_bytes(codecs.encode_png(image))
    (tmp_path / "b.tif").write_bytes(codecs.encode_tiff(image))
    rows = files.read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 2
    for r in rows:
        assert (px.array_of(r["pixels"], r["h"], r["w"]) == image).all()


def test_gray_blocks():
    tags = {codecs.BITS: (16,), codecs.SAMPLES: (1,)}
    data = np.array([[0, 256, 257, 65535]], "<u2").tobytes()
    assert codecs.decode_block(data, tags, 1, 4)[0, :, 0].tolist() == [0, 0, 1, 255]
    with pytest.raises(ValueError):
        codecs.decode_block(b"", {codecs.COMPRESSION: (7,)}, 1, 1)


@pytest.mark.parametrize("mode", [1, 4, 5])
def test_runs_write_pyramids(spark, folder, tmp_path, mode):
    paths = [str(folder / n) for n in ("s0.tif", "s1.tif", "broken.svs")]
    config = JobConfig(mode=mode, output_dir=str(tmp_path / "out"), ref_path=str(folder / "s2.tif"), tile_size=T)
    log = {r["filename"]: r for r in pipeline.run(spark, config, paths).collect()}
    assert set(log) == {"s0_norm.tiff", "s1_norm.tiff", "broken.svs"} and log["broken.svs"]["error"]
    assert log["s0_norm.tiff"]["tiles_total"] == 5 * 6 and (log["s0_norm.tiff"]["stain_H_r"] is not None) == (mode == 5)
    assert (log["s0_norm.tiff"]["total_tiles_sampled"] == 49) == (mode == 4)
    read = files.reader(str(tmp_path / "out" / "s0_norm.tiff"))
    dirs = codecs.read_tiff_directories(read)
    assert [(d[codecs.WIDTH][0], d[codecs.HEIGHT][0], d[codecs.SUBFILE][0]) for d in dirs] == [(81, 70, 0), (41, 35, 1)]
    back = files.read_tiles(spark, [str(tmp_path / "out" / "s0_norm.tiff")], T).collect()
    assert len(back) == 30 and all(r["error"] is None for r in back)
    # the first reduced level is the box mean of level 0
    full = np.zeros((80, 96, 3), np.int64)
    for r in back:
        full[r["ty"] * T : r["ty"] * T + r["h"], r["tx"] * T : r["tx"] * T + r["w"]] = px.array_of(r["pixels"], r["h"], r["w"])
    block = codecs.decode_block(read(dirs[1][codecs.TILES][0], dirs[1][codecs.TILE_BYTES][0]), dirs[1], T, T)
    sums = full[:32, :32].reshape(16, 2, 16, 2, 3).sum((1, 3))
    assert (block == (2 * sums + 4) // 8).all()
    text = glob.glob(str(tmp_path / "out" / "run_log_*.md"))
    assert len(text) == 1 and "2 of 3 slides were written, 1 failed." in open(text[0]).read()
    assert log["s0_norm.tiff"]["elapsed_s"] > 0 and log["s0_norm.tiff"]["elapsed_s"] != log["s1_norm.tiff"]["elapsed_s"]
    parts = glob.glob(str(tmp_path / "out" / "normlog_*" / "part-*.csv"))
    assert [r["filename"] for r in csv.DictReader(open(parts[0]))].count("broken.svs") == 1
    outputs = files.listing(spark, str(tmp_path / "out"))
    assert files.outputs_of(files.find_wsi_files(spark, str(folder)).select("stem"), outputs).where("output is not null").count() == 2


def test_runs_write_tiles(spark, folder, tmp_path):
    config = JobConfig(mode=2, output_dir=str(tmp_path), tile_size=T, output_format="tiles", save_log=False)
    log = pipeline.run(spark, config, [str(folder / "s0.tif"), str(folder / "s1.tif")])
    for r in log.collect():
        assert r["tiles_saved"] + r["tiles_skipped"] == r["tiles_total"]
        assert len(glob.glob(str(tmp_path / r["filename"] / "*.png"))) == r["tiles_saved"]
    total = sinks.run_summary(log).first()
    assert (total["slides"], total["completed"], total["errors"]) == (2, 2, 0)
    assert glob.glob(str(tmp_path / "s0" / "s0_x0000_y0000.png"))


def test_a_run_needs_its_reference(spark, folder, tmp_path):
    with pytest.raises(ValueError):
        pipeline.run(spark, JobConfig(mode=1, output_dir=str(tmp_path)), [str(folder / "s0.tif")])
    with pytest.raises(RuntimeError):
        pipeline.run(spark, JobConfig(mode=2, output_dir=str(tmp_path)), [str(folder / "broken.svs")])


def test_images_and_empty_log(spark, folder, tmp_path):
    from tintloom.operators import normalize

    images = files.read_images(spark, str(folder / "s0.tif"))
    profile = normalize.Profile("histogram", cdf=np.cumsum(np.full((256, 3), 1 / 256), axis=0).clip(0, 1))
    out = pipeline.normalize_images(images, profile)
    made = sinks.write_images(out, str(tmp_path), "png").collect()
    assert [(r["file"], r["error"]) for r in made] == [("s0_norm.png", None)]
    again = files.read_images(spark, str(tmp_path)).first()
    assert again["pixels"] == out.first()["pixels"]
    assert sinks.write_csv_log(pipeline.log_rows(spark, []), str(tmp_path), "m", "t") is None


def test_stream_of_tiles(spark, folder, tmp_path):
    from tintloom.operators import normalize

    tiles = files.read_tiles(spark, [str(folder / "s1.tif")], T).selectExpr("0 slide_id", "tx", "ty", "h", "w", "pixels")
    tiles.write.parquet(str(tmp_path / "in"))
    profile = normalize.Profile("vahadane", stains=np.array([[0.65, 0.704, 0.286], [0.072, 0.99, 0.105]]))
    watch.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), profile, once=True).awaitTermination()
    a, b = ({(r["tx"], r["ty"]): bytes(r["pixels"]) for r in d.collect()} for d in (spark.read.parquet(str(tmp_path / "out")), normalize.normalize_tiles(tiles, profile)))
    assert a == b and len(a) == 16


def broken_slide(spark, folder, tmp_path, spoil):
    """A pyramid made of s1.tif (16 tiles), with bytes changed by spoil(data, directory)."""
    config = JobConfig(mode=2, output_dir=str(tmp_path / "made"), tile_size=T, save_log=False)
    pipeline.run(spark, config, [str(folder / "s1.tif")]).collect()
    path = tmp_path / "made" / "s1_norm.tiff"
    data = bytearray(path.read_bytes())
    spoil(data, codecs.read_tiff_directories(files.reader(str(path)))[0])
    (tmp_path / "bad;slide.tiff").write_bytes(bytes(data))
    return str(tmp_path / "bad;slide.tiff")


def one_row(data, top):
    for at in top[codecs.TILES][4:8]:
        data[at : at + 8] = b"\xff" * 8


def every_row(data, top):
    for at in top[codecs.TILES]:
        data[at : at + 8] = b"\xff" * 8


def other_compression(data, top):
    # the entry of the compression tag: its number, kind 3, one value of 8
    entry = struct.pack("<HHQH", codecs.COMPRESSION, 3, 1, 8)
    while (at := bytes(data).find(entry)) >= 0:
        data[at + 12 : at + 14] = struct.pack("<H", 7)


@pytest.mark.parametrize("spoil", [one_row, every_row, other_compression])
@pytest.mark.parametrize("kind", ["wsi", "tiles"])
def test_a_slide_with_unreadable_tiles_is_an_error_row(spark, folder, tmp_path, spoil, kind):
    bad = broken_slide(spark, folder, tmp_path, spoil)
    config = JobConfig(mode=2, output_dir=str(tmp_path / "out"), tile_size=T, output_format=kind)
    log = {r["filename"]: r for r in pipeline.run(spark, config, [bad, str(folder / "s0.tif")]).collect()}
    assert len(log) == 2 and log["bad;slide.tiff"]["error"]
    assert sum(r["error"] is None for r in log.values()) == 1
    assert not glob.glob(str(tmp_path / "out" / "bad*"))
    alone = JobConfig(mode=2, output_dir=str(tmp_path / "alone"), tile_size=T, save_log=False)
    pipeline.run(spark, alone, [str(folder / "s0.tif")]).collect()
    if kind == "wsi":  # the bad slide has no part in the average either
        assert (tmp_path / "out" / "s0_norm.tiff").read_bytes() == (tmp_path / "alone" / "s0_norm.tiff").read_bytes()
    with pytest.raises(RuntimeError, match="reference"):
        pipeline.run(spark, JobConfig(mode=1, output_dir=str(tmp_path / "out"), ref_path=bad, tile_size=T), [str(folder / "s0.tif")])


def test_each_tile_is_normalized_once_and_failures_are_rows(spark, folder, tmp_path, monkeypatch):
    from tintloom.operators import normalize

    calls = str(tmp_path / "calls")
    first = stained(64, 64, seed=1)[:T, :T].tobytes()

    def counted(image, profile):
        with open(calls, "a") as f:
            f.write("x")
        return image

    def failing(image, profile):
        if image.tobytes() == first:
            raise ValueError("no such stain")
        return image

    monkeypatch.setitem(normalize._REGISTRY, "histogram", counted)
    config = JobConfig(mode=2, output_dir=str(tmp_path / "out"), tile_size=T, save_log=False)
    assert pipeline.run(spark, config, [str(folder / "s1.tif")]).first()["tiles_total"] == 16
    assert len(open(calls).read()) == 16
    monkeypatch.setitem(normalize._REGISTRY, "histogram", failing)
    config = JobConfig(mode=2, output_dir=str(tmp_path / "more"), tile_size=T, save_log=False, compression="none")
    log = {r["filename"]: r["error"] for r in pipeline.run(spark, config, [str(folder / "s0.tif"), str(folder / "s1.tif")]).collect()}
    assert log == {"s0_norm.tiff": None, "s1.tif": "no such stain"} and not glob.glob(str(tmp_path / "more" / "s1*"))
    back = files.read_tiles(spark, [str(tmp_path / "more" / "s0_norm.tiff")], T).collect()
    assert len(back) == 30 and all(r["error"] is None for r in back)


def test_the_writer_refuses_incomplete_levels(spark, tmp_path):
    tiles = spark.createDataFrame([(i, 0, x, y, T, T, bytes(T * T * 3)) for i in (1, 2) for x in range(2) for y in range(2) if (i, x, y) != (2, 1, 0)], "slide_id int, level int, tx int, ty int, h int, w int, pixels binary")
    slides = spark.createDataFrame([(i, f"s{i}", [30], [30], 100.0, 3) for i in (1, 2, 3)], "slide_id int, stem string, widths array<int>, heights array<int>, resolution double, unit int")
    out = {r["slide_id"]: r["error"] for r in sinks.write_pyramids(tiles, slides, str(tmp_path), T).collect()}
    assert out[1] is None and "3 of 4" in out[2] and "none" in out[3]
    assert [os.path.basename(p) for p in glob.glob(str(tmp_path / "*.tiff"))] == ["s1_norm.tiff"]


def lzw(data):
    """A plain encoder, which clears its table before the codes grow beyond 9 bits."""
    codes, table, now = [256], {bytes([i]): i for i in range(256)}, b""
    for i in range(len(data)):
        one = data[i : i + 1]
        if now + one in table:
            now += one
            continue
        codes.append(table[now])
        table[now + one] = len(table) + 2
        now = one
        if len(table) > 480 - 258 + 256:
            codes += [table[now], 256]
            table, now = {bytes([i]): i for i in range(256)}, b""
    codes += ([table[now]] if now else []) + [257]
    bits = "".join(f"{c:09b}" for c in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_block_layouts():
    image = stained(8, 9, seed=4)
    steps = np.diff(image, axis=1, prepend=np.zeros((8, 1, 3), np.uint8))
    rgb = {codecs.BITS: (8, 8, 8), codecs.SAMPLES: (3,)}
    assert (codecs.decode_block(steps.tobytes(), rgb | {codecs.PREDICTOR: (2,)}, 8, 9) == image).all()
    assert (codecs.decode_block(lzw(image.tobytes()), rgb | {codecs.COMPRESSION: (5,)}, 8, 9) == image).all()
    gray = {codecs.BITS: (16,), codecs.SAMPLES: (1,), codecs.ORDER: ">"}
    assert codecs.decode_block(np.array([[0, 257, 65535]], ">u2").tobytes(), gray, 1, 3)[0, :, 0].tolist() == [0, 1, 255]
    for wrong in ({codecs.PLANAR: (2,)}, {codecs.PREDICTOR: (3,)}, {codecs.BITS: (32,)}):
        with pytest.raises(ValueError):
            codecs.decode_block(image.tobytes(), rgb | wrong, 8, 9)
    with pytest.raises(ValueError):
        codecs.decode_block(image.tobytes()[:50], rgb, 8, 9)


def test_settings_without_effect_are_refused(tmp_path):
    for wrong in ({"compression": "webp"}, {"jpeg_quality": 80}, {"jpeg_quality": 101, "compression": "jpeg"}, {"source_scope": "slide"}, {"source_scope": "image"}):
        assert JobConfig(mode=2, output_dir=str(tmp_path), **wrong).problems(1)
    assert not JobConfig(mode=2, output_dir=str(tmp_path)).problems(1)
