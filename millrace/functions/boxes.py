"""Column functions on boxes, given as corner columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]
#: Fixed value: limit of predicted log sizes.
DELTA_LIMIT = math.log(1000 / 16)


def area(b: Box, pixel: float = 0.0) -> Column:
    return (b[2] - b[0] + pixel) * (b[3] - b[1] + pixel)


def intersection(a: Box, b: Box, pixel: float = 0.0) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + pixel
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + pixel
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, pixel: float = 0.0) -> Column:
    """Intersection over union; ``pixel`` 1 counts both border pixels."""
    i = intersection(a, b, pixel)
    return i / (area(a, pixel) + area(b, pixel) - i)


def clip(b: Box, width: float, height: float) -> list[Column]:
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    return [inside(b[0], width), inside(b[1], height), inside(b[2], width), inside(b[3], height)]


def nonempty(b: Box, least: float = 0.0) -> Column:
    return ((b[2] - b[0]) > least) & ((b[3] - b[1]) > least)


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Corners with border pixels counted: the far corner is one pixel short."""
    return [x, y, x + w - 1, y + h - 1]


def normalised(b: Box, width: float, height: float) -> list[Column]:
    return [b[0] / width, b[1] / height, b[2] / width, b[3] / height]


def encode(src: Box, dst: Box) -> list[Column]:
    """Deltas (dx, dy, dw, dh) that take ``src`` to ``dst``."""
    sw, sh, dw, dh = src[2] - src[0], src[3] - src[1], dst[2] - dst[0], dst[3] - dst[1]
    cx = lambda b, w: b[0] + 0.5 * w
    cy = lambda b, h: b[1] + 0.5 * h
    return [(cx(dst, dw) - cx(src, sw)) / sw, (cy(dst, dh) - cy(src, sh)) / sh, F.log(dw / sw), F.log(dh / sh)]


def decode(src: Box, deltas: Sequence[Column]) -> list[Column]:
    w, h = src[2] - src[0], src[3] - src[1]
    x, y = src[0] + 0.5 * w + deltas[0] * w, src[1] + 0.5 * h + deltas[1] * h
    nw, nh = (F.exp(F.least(d, F.lit(DELTA_LIMIT))) * s for d, s in ((deltas[2], w), (deltas[3], h)))
    return [x - 0.5 * nw, y - 0.5 * nh, x + 0.5 * nw, y + 0.5 * nh]


def pyramid_level(b: Box, least: int = 2, most: int = 5, canonical: int = 4, size: int = 224) -> Column:
    level = F.floor(canonical + F.log2(F.sqrt(area(b)) / size + 1e-8))
    return F.least(F.greatest(level, F.lit(least)), F.lit(most)).cast("int")


def shortest_edge(height: Column, width: Column, size: int, most: int) -> list[Column]:
    """Image size with the shortest edge ``size`` and the longest at most ``most``, rounded half up."""
    scale = F.lit(float(size)) / F.least(height, width)
    scale = F.when(F.greatest(height, width) * scale > most, F.lit(float(most)) / F.greatest(height, width)).otherwise(scale)
    return [F.floor(height * scale + 0.5).cast("int"), F.floor(width * scale + 0.5).cast("int")]
