"""Settings of a normalization job, and the fixed values that its results depend on."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Fixed values.
TILE_SIZE = 512
MIN_VALID_TILES = 5
IQR_MULTIPLIER = 1.5
BIOPSY_GRID = 7
TMA_GRID = 12
TMA_TOP_PERCENTILE = 75
WHITE_LEVEL = 230
WHITE_SHARE = 0.90
BACKGROUND_L = 88.0
SAVE_MIN_SCORE = 5.0
OD_THRESHOLD = 0.15
MACENKO_TAIL = 0.15
MIN_TISSUE_PIXELS = 100
CONCENTRATION_PERCENTILE = 0.99
CONCENTRATION_EPS = 1e-6
DEFAULT_STAINS = ((0.650, 0.704, 0.286), (0.072, 0.990, 0.105))
DEFAULT_MAX_CONCENTRATIONS = (1.0, 1.0)
VAHADANE_LAMBDA = 0.1
VAHADANE_ROUNDS = 50
REINHARD_SIGMA_FLOOR = 1e-6
OD_CLIP = (1, 254)
DEFAULT_MPP = 0.25
THUMBNAIL = 1024
PREVIEW_TILE = 512
LOG_VERSION = "1.1"
JPEG_QUALITY = 80
WSI_SUFFIXES = (".svs", ".ndpi", ".scn", ".mrxs", ".vms", ".vmu", ".tif", ".tiff", ".bif")
DOCUMENTED_SUFFIXES = (".dcm", ".ndpis")
IMAGE_SUFFIXES = (".tif", ".tiff", ".jpg", ".jpeg", ".bmp")
MODES = {
    1: ("HistMatch-Reference", "1 – Histogram matching — reference image"),
    2: ("HistMatch-BatchAvg", "2 – Histogram matching — batch average"),
    3: ("Reinhard-Reference", "3 – Reinhard — reference image"),
    4: ("Reinhard-BatchAvg", "4 – Reinhard — batch average"),
    5: ("Macenko-Reference", "5 – Macenko — reference image"),
    6: ("Vahadane-Reference", "6 – Vahadane — reference image"),
}
REFERENCE_MODES = (1, 3, 5, 6)


@dataclass(frozen=True)
class JobConfig:
    """One run: which method, over which slides, into which output.

    ``source_scope`` is ``tile``, for each tile's own statistics, or in modes 3 and 4 ``slide``, for those of the slide's sampled windows.
    ``compression`` of pyramids is ``deflate``, ``none`` or ``jpeg``, which takes ``jpeg_quality`` (1 to 100, 80 if not given).
    ``own`` names a method given to ``normalize.register_method``, which takes the place of the mode's; the mode then says
    whether its target is the reference (odd modes and 6) or the batch. ``orientation`` is ``as_reference`` or ``positive`` (see ``stains.basis``).
    """

    mode: int
    output_dir: str
    ref_path: str | None = None
    slide_type: str = "biopsy"
    tile_size: int = TILE_SIZE
    compression: str = "deflate"
    jpeg_quality: int | None = None
    output_format: str = "wsi"
    save_log: bool = True
    source_scope: str = "tile"
    orientation: str = "as_reference"
    input_folder: str | None = None
    own: str | None = None
    n_workers: int = 4  # kept for callers; Spark sets the parallelism

    @property
    def method(self) -> str:
        return self.own or MODES[self.mode][0]

    @property
    def label(self) -> str:
        return MODES[self.mode][1]

    def problems(self, n_slides: int, exists=os.path.isfile) -> list[str]:
        """What keeps this job from running; empty if nothing does."""
        found = []
        if n_slides < 1:
            found.append("no slides are loaded")
        if self.mode not in MODES:
            return [*found, f"unknown mode {self.mode}"]
        if self.mode in REFERENCE_MODES and not (self.ref_path and exists(self.ref_path)):
            found.append("this mode needs a reference slide that exists")
        if not self.output_dir:
            found.append("no output folder is set")
        choices = (("slide_type", ("biopsy", "tma")), ("compression", ("deflate", "none", "jpeg")), ("output_format", ("wsi", "tiles")), ("source_scope", ("tile", "slide")), ("orientation", ("as_reference", "positive")))
        found += [f"{name} must be one of {', '.join(allowed)}" for name, allowed in choices if getattr(self, name) not in allowed]
        if self.jpeg_quality is not None and (self.compression != "jpeg" or self.output_format != "wsi"):
            found.append("jpeg_quality has no use but with pyramids of compression jpeg")
        if self.jpeg_quality is not None and not 1 <= self.jpeg_quality <= 100:
            found.append("jpeg_quality goes from 1 to 100")
        if self.source_scope == "slide" and self.mode not in (3, 4):
            found.append("only modes 3 and 4 take statistics of the whole source slide")
        if self.tile_size < 1:
            found.append("tile_size must be positive")
        return found
