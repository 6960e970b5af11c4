"""Colour mathematics, as Column expressions for long pixels and as NumPy for packed tiles.

Every formula stands here twice, once for each form; the tests hold them
against each other. Rounding differs on purpose: LAB to RGB rounds half to even,
optical density to RGB and 16-bit to 8-bit truncate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_STAINS, OD_CLIP

# The sRGB matrices and the D65 white point.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
KNEE = 6.0 / 29.0
CHANNELS = ("r", "g", "b")


def _d(value) -> Column:
    return F.lit(float(value))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, _d(low)), _d(high))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v > _d(0.04045), F.pow((v + _d(0.055)) / _d(1.055), _d(2.4))).otherwise(v / _d(12.92))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v > _d(0.0031308), _d(1.055) * F.pow(v, _d(1 / 2.4)) - _d(0.055)).otherwise(v * _d(12.92))


def lab_f(t: Column) -> Column:
    return F.when(t > _d(KNEE**3), F.cbrt(t)).otherwise(t / _d(3 * KNEE**2) + _d(4 / 29))


def lab_f_inverse(t: Column) -> Column:
    return F.when(t > _d(KNEE), t * t * t).otherwise(_d(3 * KNEE**2) * (t - _d(4 / 29)))


def _mix(row, parts: list[Column]) -> Column:
    return _d(row[0]) * parts[0] + _d(row[1]) * parts[1] + _d(row[2]) * parts[2]


def rgb_to_lab(df, names=CHANNELS, out=("l_", "a_", "b_")):
    """df with the LAB columns. Intermediate columns keep each formula to one evaluation."""
    kept = df.columns
    df = df.select("*", *(srgb_to_linear(F.col(c).cast("double") / _d(255)).alias(f"__lin{i}") for i, c in enumerate(names)))
    lin = [F.col(f"__lin{i}") for i in range(3)]
    df = df.select(*kept, *((_mix(row, lin) / _d(w)).alias(f"__xyz{i}") for i, (row, w) in enumerate(zip(RGB_TO_XYZ, WHITE, strict=True))))
    df = df.select(*kept, *(lab_f(F.col(f"__xyz{i}")).alias(f"__f{i}") for i in range(3)))
    f = [F.col(f"__f{i}") for i in range(3)]
    return df.select(*kept, (_d(116) * f[1] - _d(16)).alias(out[0]), (_d(500) * (f[0] - f[1])).alias(out[1]), (_d(200) * (f[1] - f[2])).alias(out[2]))


def lightness(df, names=CHANNELS, out="l_"):
    """df with L* alone, for the background mask."""
    kept = df.columns
    lin = [srgb_to_linear(F.col(c).cast("double") / _d(255)) for c in names]
    df = df.select("*", (_mix(RGB_TO_XYZ[1], lin) / _d(WHITE[1])).alias("__y"))
    return df.select(*kept, (_d(116) * lab_f(F.col("__y")) - _d(16)).alias(out))


def lab_to_rgb(df, names=("l_", "a_", "b_"), out=("r2", "g2", "b2")):
    """df with 0..255 integers: linear light is clipped before the gamma, and the result rounds half to even."""
    kept = df.columns
    fy = (F.col(names[0]) + _d(16)) / _d(116)
    df = df.select("*", (F.col(names[1]) / _d(500) + fy).alias("__f0"), fy.alias("__f1"), (fy - F.col(names[2]) / _d(200)).alias("__f2"))
    df = df.select(*kept, *((lab_f_inverse(F.col(f"__f{i}")) * _d(w)).alias(f"__xyz{i}") for i, w in enumerate(WHITE)))
    xyz = [F.col(f"__xyz{i}") for i in range(3)]
    df = df.select(*kept, *(clamp(_mix(row, xyz), 0, 1).alias(f"__lin{i}") for i, row in enumerate(XYZ_TO_RGB)))
    return df.select(*kept, *(F.rint(clamp(linear_to_srgb(F.col(f"__lin{i}")), 0, 1) * _d(255)).cast("int").alias(c) for i, c in enumerate(out)))


def rgb_to_od(v: Column) -> Column:
    return -F.log(F.least(F.greatest(v, F.lit(OD_CLIP[0])), F.lit(OD_CLIP[1])).cast("double") / _d(255))


def od_to_rgb(od: Column) -> Column:
    return F.floor(clamp(F.exp(-od) * _d(255), 0, 255)).cast("int")


def gray16_to_8(v: Column) -> Column:
    return F.floor(v.cast("double") / _d(65535) * _d(255)).cast("int")


def ols_weights(stains=DEFAULT_STAINS) -> np.ndarray:
    """The 2 x 3 matrix that takes an optical density to its least-squares concentrations."""
    s = np.asarray(stains, float)
    (a, b), (_, d) = s @ s.T
    return np.array([[d, -b], [-b, a]]) / (a * d - b * b) @ s


def concentrations(ods: list[Column], stains=DEFAULT_STAINS) -> list[Column]:
    return [_mix(row, ods) for row in ols_weights(stains).tolist()]


# NumPy twins, for packed tiles.


def np_rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    lut = np.arange(256) / 255.0
    lut = np.where(lut > 0.04045, ((lut + 0.055) / 1.055) ** 2.4, lut / 12.92)
    xyz = lut[rgb] @ (np.array(RGB_TO_XYZ).T / np.array(WHITE))
    f = np.where(xyz > KNEE**3, np.cbrt(xyz), xyz / (3 * KNEE**2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def np_lab_to_rgb(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([lab[..., 1] / 500 + fy, fy, fy - lab[..., 2] / 200], -1)
    xyz = np.where(f > KNEE, f**3, 3 * KNEE**2 * (f - 4 / 29)) * np.array(WHITE)
    lin = np.clip(xyz @ np.array(XYZ_TO_RGB).T, 0, 1)
    out = np.where(lin > 0.0031308, 1.055 * lin ** (1 / 2.4) - 0.055, 12.92 * lin)
    return np.rint(np.clip(out, 0, 1) * 255).astype(np.uint8)


_OD = -np.log(np.clip(np.arange(256), *OD_CLIP) / 255.0)


def np_rgb_to_od(rgb: np.ndarray) -> np.ndarray:
    return _OD[rgb]


def np_od_to_rgb(od: np.ndarray) -> np.ndarray:
    return np.clip(np.exp(-od) * 255, 0, 255).astype(np.uint8)
