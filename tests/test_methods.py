"""A method of one's own through a whole run, and grids in SQL."""

import numpy as np
import pytest

from tintloom.config import JobConfig
from tintloom.functions import tables
from tintloom.operators import grid, normalize
from tintloom.plans import pipeline
from tintloom.sources import codecs, files, pixels as px

from .fixtures import stained

T = 16


def shift_method():
    """Moves the mean colour of a tile to that of the sampled tiles."""

    def finish(sums):
        return normalize.Profile("shift", mu=sums[:3] / sums[3])

    def apply(image, profile):
        return np.clip(image + (profile.mu - image.reshape(-1, 3).mean(0)), 0, 255).astype(np.uint8)

    return normalize.Method("shift", apply, lambda t: np.r_[t.reshape(-1, 3).sum(0), t.shape[0] * t.shape[1]], finish)


def test_a_method_of_ones_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(normalize, "METHODS", {})
    monkeypatch.setattr(normalize, "_REGISTRY", dict(normalize._REGISTRY))
    for i in range(2):
        (tmp_path / f"s{i}.tif").write_bytes(codecs.encode_tiff(stained(64, 80, seed=i)))
    paths = [str(tmp_path / f"s{i}.tif") for i in range(2)]
    config = JobConfig(mode=1, own="shift", ref_path=paths[1], output_dir=str(tmp_path / "out"), tile_size=T, save_log=False)
    with pytest.raises(ValueError, match="no method"):
        pipeline.run(spark, config, paths[:1])
    normalize.register_method(shift_method())
    row = pipeline.run(spark, config, paths[:1]).first()
    assert row["error"] is None and row["method"] == "shift"
    # the same by hand: the mean of the reference's used windows
    slides = spark.createDataFrame([(0, paths[1], 80, 64)], "slide_id int, path string, width int, height int")
    places = grid.sampling_grid(slides, "biopsy", T)
    windows = files.read_windows(places.withColumn("path", px.F.lit(paths[1])), T).cache()
    used = pipeline.score_windows(windows, config).where("used").select("seq")
    mean = np.mean([px.array_of(r["pixels"], T, T).reshape(-1, 3).mean(0) for r in windows.join(used, "seq").collect()], axis=0)
    image = stained(64, 80, seed=0)
    for r in files.read_tiles(spark, [str(tmp_path / "out" / "s0_norm.tiff")], T).collect():
        tile = image[r["ty"] * T : r["ty"] * T + T, r["tx"] * T : r["tx"] * T + T]
        want = normalize.np_with_background(tile, normalize.Profile("shift", mu=mean), shift_method().apply)
        assert np.abs(px.array_of(r["pixels"], r["h"], r["w"]).astype(int) - want).max() <= 1
    with pytest.raises(RuntimeError):
        normalize.fit_method(spark.createDataFrame([], px.TILES), shift_method())


def test_grids_in_sql(spark):
    tables.register(spark)
    slides = spark.createDataFrame([(0, 400, 300), (1, 5, 50), (2, 37, 37)], "slide_id int, width int, height int")
    for kind in ("biopsy", "tma"):
        own = spark.sql("SELECT slide_id, seq, x, y FROM {slides}, LATERAL sampling_grid(width, height, {tile}, {kind})", slides=slides, tile=T, kind=kind)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, grid.sampling_grid(slides, kind, T).collect()))
    own = spark.sql("SELECT slide_id, tx, ty, x, y, w, h FROM {slides}, LATERAL tile_grid(width, height, 16)", slides=slides)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, grid.full_grid(slides, T).drop("file").collect()))
    assert spark.sql("SELECT * FROM tile_grid(NULL, 3, 16)").count() == 0
