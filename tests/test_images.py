"""The image runner, thumbnails, and runs that are watched and cancelled."""

import csv
import glob
import os
import threading
import time

import numpy as np
import pytest

from tintloom.config import JobConfig
from tintloom.functions.color import np_rgb_to_lab
from tintloom.operators import normalize, packed, quality
from tintloom.plans import images, pipeline
from tintloom.plans.progress import Background, Watch
from tintloom.sources import codecs, files, pixels as px

from .fixtures import stained

T = 16


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    for i, (name, shape) in enumerate([("a.tif", (40, 33)), ("b.bmp", (20, 61)), ("c.jpg", (48, 48)), ("c.tiff", (9, 9))]):
        (d / name).write_bytes(codecs.encode_image(stained(*shape, seed=i), name.rsplit(".", 1)[1]))
    (d / "broken.jpeg").write_bytes(b"\xff\xd8\xff")
    (d / "short.tif").write_bytes(b"II*\0")
    (d / "notes.txt").write_bytes(b"no image")
    (d / "sub").mkdir()
    return d


@pytest.mark.parametrize("kind,ending", [("histogram", "tif"), ("reinhard", "png")])
def test_a_folder_of_images(spark, folder, tmp_path, kind, ending):
    timings = quality.Timings(spark)
    rows = images.run_images(spark, str(folder), str(tmp_path / "out"), kind, ending=ending, timings=timings).collect()
    errors = {r["filename"]: r["error"] for r in rows if r["error"] is not None}
    assert set(errors) == {"broken.jpeg", "short.tif", "c.tiff"} and "same file" in errors["c.tiff"]
    good = {(r["filename"], r["channel"]): r for r in rows if r["error"] is None}
    assert {k[0] for k in good} == {"a.tif", "b.bmp", "c.jpg"} and len(good) == 9
    assert sorted(os.listdir(tmp_path / "out"))[0].startswith("a_norm") and not glob.glob(str(tmp_path / "out" / ".tintloom*"))
    source = {n: codecs.decode_image((folder / n).read_bytes()) for n in ("a.tif", "b.bmp", "c.jpg")}
    batch = [*source.values(), codecs.decode_image((folder / "c.tiff").read_bytes())]  # a second of its name, but readable
    if kind == "histogram":
        pixels = np.concatenate([x.reshape(-1, 3) for x in batch])
        profile = normalize.Profile(kind, cdf=np.stack([np.cumsum(np.bincount(pixels[:, i], minlength=256)) / len(pixels) for i in range(3)], -1))
    else:
        lab = [np_rgb_to_lab(x).reshape(-1, 3) for x in batch]
        profile = normalize.Profile(kind, mu=np.mean([x.mean(0) for x in lab], 0), sigma=np.mean([x.std(0) for x in lab], 0))
    for name, before in source.items():
        after = codecs.decode_image((tmp_path / "out" / f"{name[0]}_norm.{ending}").read_bytes())
        assert (np.abs(after.astype(int) - normalize._REGISTRY[kind](before, profile)) <= (kind == "reinhard")).all()
        for i, ch in enumerate("RGB" if kind == "histogram" else "Lab"):
            x, y = ((v if kind == "histogram" else np_rgb_to_lab(v))[..., i].ravel() for v in (before, after))
            gap = np.abs(np.cumsum(np.bincount(x, minlength=256)) - np.cumsum(np.bincount(y, minlength=256))).sum() / x.size / 256 if kind == "histogram" else np.abs(y - x).mean()
            want = [x.mean(), x.std(), y.mean(), y.std(), gap]
            got = list(good[name, ch].asDict().values())[2:7]
            assert np.allclose(got, want, atol=1e-9)
    found = [r for f in glob.glob(str(tmp_path / "out" / "normlog_*" / "part-*.csv")) for r in csv.DictReader(open(f))]
    assert len(found) == len(rows) and [r["filename"] for r in found] == sorted(r["filename"] for r in found)
    calls = {k: v[0] for k, v in timings.tasks.items()}
    assert calls["io.save"] == calls["algo.measure"] == 3


def test_image_batches_that_cant_run(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"II")
    with pytest.raises(RuntimeError):
        images.run_images(spark, str(tmp_path), str(tmp_path / "out"), "histogram")
    with pytest.raises(ValueError):
        images.run_images(spark, str(tmp_path), str(tmp_path / "out"), "histogram", ending="gif")


def plain_thumbnail(image, max_size):
    h, w = image.shape[:2]
    if max(h, w) <= max_size:
        return image
    tw, th = max(1, w * max_size // max(h, w)), max(1, h * max_size // max(h, w))
    fine = image.astype(np.int64).repeat(th, axis=0).repeat(tw, axis=1)  # th x tw units a pixel, h x w units a target
    sums = fine.reshape(th, h, tw, w, 3).sum((1, 3))
    return ((2 * sums + h * w) // (2 * h * w)).astype(np.uint8)


@pytest.mark.parametrize("max_size", [1, 7, 16, 40, 64, 500])
def test_thumbnails_of_any_size(spark, max_size):
    pictures = {0: stained(45, 64, seed=1), 1: stained(33, 20, seed=2), 2: stained(3, 50, seed=3)}
    rows = [(i, x // T, y // T, min(T, p.shape[0] - y), min(T, p.shape[1] - x), np.ascontiguousarray(p[y : y + T, x : x + T]).tobytes()) for i, p in pictures.items() for y in range(0, p.shape[0], T) for x in range(0, p.shape[1], T)]
    slides = spark.createDataFrame([(i, p.shape[1], p.shape[0]) for i, p in pictures.items()], "slide_id int, width int, height int")
    found = packed.thumbnails(spark.createDataFrame(rows, px.TILES), slides, T, max_size).collect()
    for i, p in pictures.items():
        want = plain_thumbnail(p, max_size)
        own = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in found if r["slide_id"] == i}
        assert len(own) == want.shape[0] * want.shape[1]
        assert all(own[x, y] == tuple(want[y, x]) for y in range(want.shape[0]) for x in range(want.shape[1]))


@pytest.fixture(scope="module")
def slides(tmp_path_factory):
    d = tmp_path_factory.mktemp("slides")
    for i in range(6):
        (d / f"s{i}.tif").write_bytes(codecs.encode_tiff(stained(40, 48, seed=i)))
    return d


def test_a_run_is_cancelled_from_another_thread(spark, slides, tmp_path, monkeypatch):
    gate, second = str(tmp_path / "gate"), stained(40, 48, seed=2)[:T, :T].tobytes()

    def slow(image, profile):
        if image.tobytes() == second:  # a tile of the second wave waits to be cancelled
            open(gate, "w").close()
            time.sleep(120)
        return image

    monkeypatch.setitem(normalize._REGISTRY, "histogram", slow)
    config = JobConfig(mode=2, output_dir=str(tmp_path / "out"), tile_size=T, save_log=False)
    watch, seen = Watch(spark, wave=2), []
    paths = [str(slides / f"s{i}.tif") for i in range(6)]
    job = Background(watch, lambda w: pipeline.run(spark, config, paths, watch=w))
    until = time.time() + 120
    while not os.path.exists(gate) and time.time() < until:
        seen.append(watch.progress())
        time.sleep(0.2)
    with pytest.raises(TimeoutError):
        job.result(0.1)
    began = time.time()
    watch.cancel()
    log = {r["filename"]: r for r in job.result(100).collect()}
    assert time.time() - began < 60
    assert {k: (r["error"], r["method"]) for k, r in log.items()} == {
        **{f"s{i}_norm.tiff": (None, "HistMatch-BatchAvg") for i in (0, 1)},
        **{f"s{i}.tif": ("cancelled", None) for i in (2, 3)},
        **{f"s{i}.tif": ("not started", None) for i in (4, 5)},
    }
    assert log["s2.tif"]["elapsed_s"] == 0 and log["s4.tif"]["elapsed_s"] is None
    assert sorted(os.listdir(tmp_path / "out")) == ["s0_norm.tiff", "s1_norm.tiff"]
    assert max(p["tasks"] for p in seen) > 0 and watch.progress()["slides_done"] == 2 and watch.total == 6
    assert spark.range(5).count() == 5 and threading.active_count() > 0  # the session goes on


def test_a_watched_run_that_ends_by_itself(spark, slides, tmp_path):
    watch = Watch(spark, wave=2)
    config = JobConfig(mode=2, output_dir=str(tmp_path), tile_size=T, save_log=False, output_format="tiles")
    log = Background(watch, lambda w: pipeline.run(spark, config, [str(slides / f"s{i}.tif") for i in range(3)], watch=w)).result().collect()
    assert [r["error"] for r in log] == [None] * 3 and watch.progress() == {"slides": 3, "slides_done": 3, "tasks": 0, "tasks_done": 0}
    bad = Background(Watch(spark), lambda w: pipeline.run(spark, JobConfig(mode=9, output_dir="x"), ["y"], watch=w))
    with pytest.raises(ValueError):
        bad.result()


def test_a_preview_of_what_a_run_wrote(spark, slides, tmp_path):
    config = JobConfig(mode=2, output_dir=str(tmp_path), tile_size=T, save_log=False)
    pipeline.run(spark, config, [str(slides / "s0.tif")]).collect()
    out = spark.createDataFrame([(0, str(tmp_path / "s0_norm.tiff"), 48, 40)], "slide_id int, path string, width int, height int")
    small = packed.thumbnails(files.tiles_of(out, T), out, T, 10)
    assert small.agg({"x": "max", "y": "max"}).first().asDict() == {"max(x)": 9, "max(y)": 7}
