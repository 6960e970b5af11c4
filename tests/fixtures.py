"""Hand-made slides: white, flat, two-stain, edge and tiny ones."""

import numpy as np

from tintloom.config import DEFAULT_STAINS


def stained(h, w, seed=0, white=0.2):
    """A tile of two mixed stains with some background."""
    rng = np.random.default_rng(seed)
    c = np.stack([rng.gamma(2.0, 0.35, (h, w)), rng.gamma(2.0, 0.3, (h, w))], -1)
    image = np.clip(np.exp(-(c @ np.array(DEFAULT_STAINS))) * 255, 0, 255).astype(np.uint8)
    image[rng.random((h, w)) < white] = (246, 245, 247)
    return image


def long_rows(images, tile):
    """Rows of the long form of {slide_id: image}."""
    rows = []
    for slide, image in images.items():
        for y in range(image.shape[0]):
            for x in range(image.shape[1]):
                rows.append((slide, x // tile, y // tile, x, y, *map(int, image[y, x])))
    return rows


PIXELS = "slide_id int, tx int, ty int, x int, y int, r int, g int, b int"


def frame(spark, images, tile):
    return spark.createDataFrame(long_rows(images, tile), PIXELS)


def image_of(rows, names=("r2", "g2", "b2")):
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    out = np.zeros((h, w, 3), np.uint8)
    for r in rows:
        out[r["y"], r["x"]] = [r[n] for n in names]
    return out
