import numpy as np
import pytest
from pyspark.sql import functions as F

from tintloom.config import DEFAULT_STAINS, JobConfig
from tintloom.functions import color, names
from tintloom.operators import grid, normalize, packed, pyramid, quality, stains, stats, tissue
from tintloom.plans import pipeline
from tintloom.sources import pixels as px

from .fixtures import frame, image_of, stained

T = 10


@pytest.fixture(scope="module")
def images():
    white = np.full((30, 40, 3), 255, np.uint8)
    flat = np.full((30, 40, 3), (120, 80, 150), np.uint8)
    return {0: stained(45, 52, 1), 1: stained(38, 61, 2, 0.4), 2: white, 3: flat}


@pytest.fixture(scope="module")
def pixels(spark, images):
    return frame(spark, images, T).persist()


def test_grids_and_windows(spark, images, pixels):
    slides = px.info(pixels)
    for kind, n in (("biopsy", 7), ("tma", 12)):
        got = {}
        for r in grid.sampling_grid(slides, kind, T).orderBy("slide_id", "seq").collect():
            got.setdefault(r["slide_id"], []).append((r["x"], r["y"]))
        for s, image in images.items():
            h, w = image.shape[:2]
            xs, ys = (np.floor(np.linspace(T, dim - 2 * T, n)).astype(int).tolist() for dim in (w, h))
            want = [(x, y) for x in xs for y in ys]
            if kind == "biopsy":
                want.sort(key=lambda p: (p[0] - w / 2) ** 2 + (p[1] - h / 2) ** 2)
            assert got[s] == want
    cut = packed.cut_windows(px.pack(pixels), grid.sampling_grid(slides, "biopsy", T), T)
    for r in cut.where("slide_id = 0").collect():
        want = np.zeros((T, T, 3), np.uint8)
        for y in range(T):
            for x in range(T):
                if 0 <= r["y"] + y < 45 and 0 <= r["x"] + x < 52:
                    want[y, x] = images[0][r["y"] + y, r["x"] + x]
        assert (px.array_of(r["pixels"], T, T) == want).all()


def test_tiny_slides_have_falling_grids(spark):
    slides = spark.createDataFrame([(0, 600, 600)], "slide_id int, width int, height int")
    xs = [r[0] for r in grid.sampling_grid(slides, "tma", 512, 7).select("x").distinct().orderBy(F.desc("x")).collect()]
    assert xs == [512, 356, 200, 44, -112, -268, -424]


def test_packed_and_long_statistics_agree(pixels):
    slides = px.info(pixels)
    long, under = stats.sample(pixels, slides, "biopsy", T)
    windows = packed.cut_windows(px.pack(pixels), grid.sampling_grid(slides, "biopsy", T), T)
    short = tissue.with_fallback(tissue.biopsy_valid(packed.window_stats(windows)))
    both = long.join(short.select("slide_id", "seq", *(F.col(c).alias(f"{c}_p") for c in ("score", "white_frac", "used"))), ["slide_id", "seq"]).collect()
    assert len(both) == 4 * 49
    for r in both:
        assert abs(r["score"] - r["score_p"]) < 1e-9 and abs(r["white_frac"] - r["white_frac_p"]) < 1e-12 and r["used"] == r["used_p"]
    for mode in (1, 2, 3, 4, 5):
        config = JobConfig(mode=mode, output_dir="/x", tile_size=T)
        a, b = pipeline.fit(pixels, slides, config, 0), pipeline.fit_packed(px.pack(pixels), slides, config, 0)
        for k in ("cdf", "mu", "sigma", "stains", "max_concentrations"):
            if getattr(a, k) is not None:
                assert np.allclose(getattr(a, k), getattr(b, k), atol=1e-9), (mode, k)


def test_packed_and_long_transforms_agree(images, pixels):
    slides = px.info(pixels)
    tiles = px.pack(pixels)
    for mode in range(1, 7):
        profile = pipeline.fit(pixels, slides, JobConfig(mode=mode, output_dir="/x", tile_size=T), 0)
        long = pipeline.transform(pixels, profile)
        short = px.unpack(normalize.normalize_tiles(tiles, profile), T)
        for s in images:
            a = image_of(long.where(F.col("slide_id") == s).collect())
            b = image_of(short.where(F.col("slide_id") == s).collect(), "rgb")
            assert np.abs(a.astype(int) - b).max() <= 1 and (a != b).mean() < 0.001, (mode, s)
        assert (image_of(long.where("slide_id = 2").collect()) == 255).all()


def test_histogram_profile_properties(pixels):
    slides = px.info(pixels)
    profile = normalize.cdf_profile(stats.slide_cdf(pixels, slides, "biopsy", T).where("slide_id = 1"))
    assert (np.diff(profile.cdf, axis=0) >= 0).all() and np.allclose(profile.cdf[-1], 1)
    own = normalize.cdf_profile(stats.cdf(stats.dense(stats.histogram(pixels.where("slide_id = 1"), []), []), []))
    image = image_of(pixels.where("slide_id = 1").collect(), "rgb")
    assert (normalize.np_histogram_match(image, own) == image).all()


def test_matching_brings_distributions_closer(pixels):
    target = pixels.where("slide_id = 0")
    profile = normalize.cdf_profile(stats.cdf(stats.dense(stats.histogram(target, []), []), []))
    one = pixels.where("slide_id = 1")
    out = normalize.histogram_match(one, profile, ["slide_id"]).select(*(F.col(f"{c}2").alias(c) for c in "rgb"), "slide_id")
    same = target.withColumn("slide_id", F.lit(1))
    before, after = ({r["ch"]: r["wasserstein"] for r in quality.wasserstein(d, same, ["slide_id"]).collect()} for d in (one, out))
    assert sum(after.values()) < 0.7 * sum(before.values()), (before, after)


def test_reinhard_reaches_the_target(pixels):
    profile = normalize.Profile("reinhard", mu=np.array([60.0, 10.0, -8.0]), sigma=np.array([8.0, 3.0, 3.0]))
    out = normalize.reinhard(pixels.where("slide_id = 1"), profile, by=["slide_id"])
    lab = stats.lab_stats(out.select("slide_id", *(F.col(f"{c}2").alias(c) for c in "rgb")), ["slide_id"]).first()
    assert all(abs(lab[f"mu_{c}"] - m) < 1.5 for c, m in zip("lab", profile.mu, strict=True))
    flat = normalize.reinhard(pixels.where("slide_id = 3"), profile, by=["slide_id"]).select("r2", "g2", "b2").distinct().collect()
    assert len(flat) == 1 and abs(flat[0]["r2"] - 120) <= 1


def test_stain_fits(spark, images, pixels):
    found = stains.fit_macenko(pixels.where("slide_id = 0"))
    assert np.allclose(np.linalg.norm(found["stain_matrix"], axis=1), 1) and found["stain_matrix"][0, 0] <= found["stain_matrix"][1, 0]
    od = color.np_rgb_to_od(images[0]).reshape(-1, 3)
    od = od[np.linalg.norm(od, axis=1) > 0.15]
    plane = np.linalg.svd(od, full_matrices=False)[2][:2].T
    plane = plane * np.where(plane.sum(0) > 0, -1, 1)
    angle = np.arctan2(od @ plane[:, 1], od @ plane[:, 0])
    ends = [plane @ [np.cos(t), np.sin(t)] for t in np.percentile(angle, [15, 85])]
    want = np.array(sorted((v / np.linalg.norm(v) for v in ends), key=lambda v: v[0]))
    assert np.allclose(found["stain_matrix"], want, atol=1e-6)
    conc = np.linalg.lstsq(want.T, od.T, rcond=None)[0]
    assert np.allclose(found["max_concentrations"], np.percentile(conc, 99, axis=1), atol=1e-6)
    upright = stains.fit_macenko(pixels.where("slide_id = 0"), "positive")["stain_matrix"]
    true = np.array(DEFAULT_STAINS) / np.linalg.norm(DEFAULT_STAINS, axis=1, keepdims=True)
    assert max(min(np.degrees(np.arccos(np.clip(v @ t, -1, 1))) for v in upright) for t in true) < 25
    v = stains.fit_vahadane(pixels.where("slide_id = 0"))["stain_matrix"]
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v >= 0).all() and v[0, 2] >= v[1, 2]
    assert max(min(np.degrees(np.arccos(np.clip(a @ t, -1, 1))) for a in v) for t in true) < 25


def test_planes_of_many_matrices_at_once(spark):
    """The closed form against an eigenvalue routine, degenerate matrices included."""
    rng = np.random.default_rng(3)
    rows = [rng.gamma(2.0, 0.4, (50, 3)) for _ in range(40)]
    rows += [np.outer(rng.random(20) + 0.1, v) for v in ((1.0, 2.0, 3.0), (1.0, 0.0, 0.0))]  # of one direction
    rows += [np.eye(3), np.diag([2.0, 1.0, 1.0]), np.diag([1.0, 2.0, 2.0])]
    grams = [x.T @ x for x in rows]
    sums = spark.createDataFrame([(i, *(float(m["rgb".index(a), "rgb".index(b)]) for a, b in stains.PAIRS)) for i, m in enumerate(grams)], "i int, " + ", ".join(f"s_{a}{b} double" for a, b in stains.PAIRS))
    for orientation, sign in (("as_reference", -1), ("positive", 1)):
        for r in stains.with_plane(sums, orientation).collect():
            own = np.array([[r[f"p_{c}{k}"] for k in (0, 1)] for c in "rgb"])
            m, values = grams[r["i"]], np.linalg.eigvalsh(grams[r["i"]])
            assert np.allclose(own.T @ own, np.eye(2), atol=1e-9)
            assert np.allclose(np.sort(np.diag(own.T @ m @ own)), values[1:], rtol=1e-9, atol=1e-9)
            assert (own.sum(0) * sign >= -1e-9).all()
            if r["i"] < 40:
                want = np.linalg.eigh(m)[1][:, ::-1][:, :2]
                want = want * np.where(want.sum(0) * sign < 0, -1, 1)
                assert np.allclose(own, want, atol=1e-8)


def plain_dictionary(od, weights, penalty=0.1, rounds=50):
    """Alternating descent over rows, codes by coordinates until they stand still."""
    atoms = np.array(DEFAULT_STAINS) / np.linalg.norm(DEFAULT_STAINS, axis=1, keepdims=True)
    for _ in range(rounds):
        g, hit, codes = atoms @ atoms.T, od @ atoms.T - penalty, np.zeros((len(od), 2))
        for _ in range(3000):
            old = codes.copy()
            for k in range(2):
                codes[:, k] = np.maximum(0, hit[:, k] - codes[:, 1 - k] * g[0, 1])
            if np.abs(codes - old).max() < 1e-13:
                break
        a, b, before = (codes * weights[:, None]).T @ codes, (codes * weights[:, None]).T @ od, atoms.copy()
        for k in range(2):
            atoms[k] = np.maximum(0, (b[k] - a[k, 1 - k] * atoms[1 - k]) / a[k, k])
            atoms[k] /= np.linalg.norm(atoms[k])
        if np.abs(atoms - before).max() < 1e-7:
            break
    return atoms


def test_dictionary_on_aggregates(spark, images, pixels):
    colours = pixels.where("slide_id = 0").groupBy("r", "g", "b").agg(F.count("*").alias("times"))
    found = stains.positive_dictionary(tissue.od_tissue(colours))
    od = color.np_rgb_to_od(images[0]).reshape(-1, 3)
    od = od[np.linalg.norm(od, axis=1) > 0.15]
    assert np.allclose(found, plain_dictionary(od, np.ones(len(od))), atol=1e-6)
    again = stains.positive_dictionary(tissue.od_tissue(colours).repartition(7))
    assert np.allclose(found, again, atol=1e-9)
    assert np.allclose(stains.positive_dictionary(tissue.od_tissue(colours).limit(0)) @ [1, 0, 0], [0.65 / np.linalg.norm(DEFAULT_STAINS[0]), 0.072 / np.linalg.norm(DEFAULT_STAINS[1])])


def test_fits_of_all_slides_at_once(spark, pixels):
    colours = pixels.groupBy("slide_id", "r", "g", "b").agg(F.count("*").alias("times"))
    rows = {r["slide_id"]: r for r in stains.fit_macenko_by(colours, ["slide_id"]).collect()}
    assert len(rows) == pixels.select("slide_id").distinct().count()
    for i, r in rows.items():
        own = stains.fit_macenko(pixels.where(f"slide_id = {i}"))
        assert np.allclose(stains.fit_of(r)["stain_matrix"], own["stain_matrix"]) and np.allclose(stains.fit_of(r)["max_concentrations"], own["max_concentrations"])
        assert r["fallback"] == (r["n"] < 100)


@pytest.mark.parametrize("n,default", [(99, True), (100, False)])
def test_minimum_tissue(spark, n, default):
    image = np.full((20, 20, 3), 255, np.uint8)
    rng = np.random.default_rng(0)
    image.reshape(-1, 3)[:n] = rng.integers(60, 160, (n, 3))
    df = frame(spark, {0: image}, T)
    for fit in (stains.fit_macenko, stains.fit_vahadane):
        assert np.allclose(fit(df)["stain_matrix"], DEFAULT_STAINS) == default


def test_white_and_fallback_boundaries(spark):
    image = np.full((10, 20, 3), 100, np.uint8)
    image[:9, :10], image[:9, 10:] = 231, 230
    flags = {r["tx"]: r["mostly_white"] for r in tissue.scored(frame(spark, {0: image}, T), ["tx"]).collect()}
    assert flags == {0: True, 1: False}
    for n, fallback in ((4, True), (5, False)):
        tiles = spark.createDataFrame([(0, i, i < n) for i in range(9)], "slide_id int, seq int, valid boolean")
        rows = tissue.with_fallback(tiles).collect()
        assert {(r["fallback"], r["valid_count"], r["total_count"]) for r in rows} == {(fallback, 9 if fallback else n, 9)}
        assert sum(r["used"] for r in rows) == (9 if fallback else n)


def test_pyramid(spark, images, pixels):
    sizes = spark.createDataFrame([(0, 4096, 4096), (1, 37000, 20000), (2, 100, 90)], "slide_id int, width int, height int")
    got = {}
    for r in pyramid.levels(sizes, 512).orderBy("factor").collect():
        got.setdefault(r["slide_id"], []).append((r["factor"], r["w"], r["h"]))
    assert [f for f, _, _ in got[1]] == [2, 4, 8, 16] and [f for f, _, _ in got[0]] == [2] and got[2] == [(2, 50, 45)]
    small = image_of(pyramid.reduce_by(pixels.where("slide_id = 0"), 4).collect(), "rgb")
    h, w = images[0].shape[:2]
    assert small.shape[:2] == (-(-h // 4), -(-w // 4))
    for y in range(small.shape[0]):
        for x in range(small.shape[1]):
            block = images[0][4 * y : 4 * y + 4, 4 * x : 4 * x + 4].reshape(-1, 3).astype(int)
            assert (small[y, x] == (2 * block.sum(0) + len(block)) // (2 * len(block))).all()


def test_names(spark):
    rows = [("/a/B.SVS", ".svs", "B"), ("c", "", "c"), ("/d.x/e", "", "e"), ("f.tar.tiff", ".tiff", "f.tar"), (".hidden", "", ".hidden")]
    df = spark.createDataFrame(rows, "p string, s string, t string").select("s", "t", names.suffix(F.col("p")).alias("s2"), names.stem(F.col("p")).alias("t2"))
    for r in df.collect():
        assert (r["s"], r["t"]) == (r["s2"], r["t2"])


def test_readable(spark):
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "path string, error string")
    assert tissue.readable(rows).count() == 1
    with pytest.raises(RuntimeError):
        tissue.readable(rows.where("error is not null"))


def test_config():
    ok = JobConfig(mode=2, output_dir="/o")
    assert ok.problems(3) == [] and ok.problems(0)
    assert JobConfig(mode=1, output_dir="/o").problems(1) and JobConfig(mode=9, output_dir="/o").problems(1)
    assert JobConfig(mode=1, output_dir="/o", ref_path="/r").problems(1, exists=lambda p: True) == []
    assert JobConfig(mode=2, output_dir="", slide_type="x").problems(1)


def test_timings(spark):
    t = quality.Timings()
    assert t.report(spark) == "No timings recorded."
    with t.time("a"):
        pass
    with t.time("a"):
        pass
    assert quality.timing_report(t.frame(spark)).first()["calls"] == 2 and "a" in t.report(spark)
    t.clear()
    assert t.rows == []


def test_own_normalizer(pixels):
    normalize.register_normalizer("invert", lambda image, profile: 255 - image)
    out = px.unpack(normalize.normalize_tiles(px.pack(pixels.where("slide_id = 3")), normalize.Profile("invert")), T)
    assert out.select("r", "g", "b").distinct().collect()[0] == (135, 175, 105)
