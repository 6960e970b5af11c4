"""Names: parts of paths, names of tiles, labels of modes, resolution tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_MPP, MODES


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows it in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def tile_name(slide: Column, tx: Column, ty: Column) -> Column:
    """Column index first, then row index."""
    return F.format_string("%s_x%04d_y%04d.png", slide.cast("string"), tx, ty)


def mode_key(mode: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for k, (name, _) in MODES.items() for v in (k, name))), mode)


def mode_label(mode: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for k, (_, label) in MODES.items() for v in (k, label))), mode)


def safe_name(name: Column) -> Column:
    return F.translate(name, " –", "_-")


def resolution(mpp: Column) -> tuple[Column, Column]:
    """Pixels per centimetre and the unit tag: a missing mpp counts as the default, one that can't be used gives (0, 1)."""
    number = F.coalesce(mpp, F.lit(str(DEFAULT_MPP))).try_cast("double")
    usable = number.isNotNull() & (number != 0)
    return F.when(usable, 10000.0 / number).otherwise(0.0), F.when(usable, 3).otherwise(1)
