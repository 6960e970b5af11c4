import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tintloom.functions import color

from .fixtures import frame, image_of, stained


def test_long_and_packed_forms_agree(spark):
    image = stained(20, 30, 1)
    df = frame(spark, {0: image}, 10)
    rows = color.lab_to_rgb(color.rgb_to_lab(df)).collect()
    lab = color.np_rgb_to_lab(image)
    for r in rows:
        assert np.allclose([r["l_"], r["a_"], r["b_"]], lab[r["y"], r["x"]], atol=1e-9)
    assert (image_of(rows) == color.np_lab_to_rgb(lab)).all()
    od = df.select("x", "y", *(color.rgb_to_od(F.col(c)).alias(c) for c in "rgb")).collect()
    for r in od:
        assert np.allclose([r["r"], r["g"], r["b"]], color.np_rgb_to_od(image)[r["y"], r["x"]], atol=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 255)] * 3), min_size=1, max_size=20))
def test_lab_round_trip_is_within_one(rows):
    rgb = np.array(rows, np.uint8)
    assert np.abs(color.np_lab_to_rgb(color.np_rgb_to_lab(rgb)).astype(int) - rgb).max() <= 1


def test_known_values():
    lab = color.np_rgb_to_lab(np.array([[255, 255, 255], [0, 0, 0], [255, 0, 0]], np.uint8))
    assert np.allclose(lab[0], [100, 0, 0], atol=0.02) and np.allclose(lab[1], 0, atol=1e-9)
    assert np.allclose(lab[2], [53.24, 80.09, 67.20], atol=0.02)


def test_least_squares_weights():
    od = np.random.default_rng(0).random((50, 3))
    s = np.array(color.DEFAULT_STAINS)
    assert np.allclose(od @ color.ols_weights().T, np.linalg.lstsq(s.T, od.T, rcond=None)[0].T)


def test_density_truncates():
    v = np.arange(256, dtype=np.uint8)
    back = color.np_od_to_rgb(color.np_rgb_to_od(v))
    assert (back.astype(int) <= np.clip(v, 1, 254)).all() and (np.clip(v, 1, 254) - back <= 1).all()
