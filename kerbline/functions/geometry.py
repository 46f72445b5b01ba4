"""Boxes, outlines, coordinates and scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.numbers import clip

TRAIN_LONG_SIDE = 640      # fixed value: long side of the training frames
NETWORK_LONG_SIDE = 518    # fixed values: long side fed to a depth network, in multiples of 14
NETWORK_STEP = 14
ZOOM_BELOW, ZOOM_TARGET = 0.05, 0.20   # fixed values: small outlines are re-read in a 518:392 window
ZOOM_W, ZOOM_H = 518, 392


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees, negative for S and W; null when a part is missing or no number."""
    value = degrees.try_cast("double") + minutes.try_cast("double") / 60.0 + seconds.try_cast("double") / 3600.0
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def corner_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Four corner points clipped to the unit square, clockwise from the top left."""
    l, t, r, b = (clip(v, 0.0, 1.0) for v in (xmin, ymin, xmax, ymax))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(pt(l, t), pt(r, t), pt(r, b), pt(l, b))


def centre_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """``corner_box`` of a box given by centre and size."""
    return corner_box(x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def loosen_box(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, by: float = 0.10) -> Column:
    """Grow a pixel box by a share of its size, clipped to the frame."""
    dx, dy = (x1 - x0) * F.lit(by) / 2, (y1 - y0) * F.lit(by) / 2
    return F.struct(F.greatest(F.lit(0.0), x0 - dx).alias("x0"), F.greatest(F.lit(0.0), y0 - dy).alias("y0"),
                    F.least(w - 1, x1 + dx).alias("x1"), F.least(h - 1, y1 + dy).alias("y1"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) points."""
    n = F.size(points)
    follow = F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % n).alias("b")))
    twice = F.aggregate(follow, F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.abs(twice) / 2.0


def area_cm2(area_px: Column, pixel_size_cm: float = 0.5) -> Column:
    return area_px * F.lit(pixel_size_cm ** 2)


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the circle with this area."""
    return 2.0 * F.sqrt(area / F.pi())


def mm_per_px(angular_size: Column, camera_mm: Column, diameter_px: Column) -> Column:
    """Ground scale; null without a camera distance."""
    width = F.when((angular_size != 0) & (camera_mm != 0), angular_size * camera_mm)
    return F.when(diameter_px > 0, width / diameter_px)


def train_scale(w: Column, h: Column) -> Column:
    """Frame size after the long side is brought to the training size (unchanged within 0.1%)."""
    s = F.lit(float(TRAIN_LONG_SIDE)) / F.greatest(w, h)
    near = F.abs(s - 1.0) < 1e-3
    side = lambda v: F.when(near, v).otherwise(F.greatest(F.lit(1), F.bround(v * s))).cast("int")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def network_size(w: Column, h: Column) -> Column:
    """Network input size: long side fixed, both sides multiples of the patch, aspect kept."""
    s = F.lit(float(NETWORK_LONG_SIDE)) / F.greatest(w, h)
    side = lambda v: F.greatest(F.lit(NETWORK_STEP), F.bround(v * s / NETWORK_STEP) * NETWORK_STEP).cast("int")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def zoom_window(area: Column, x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Window, as frame shares, in which a small outline fills about a fifth; null when not needed or not possible."""
    aspect = ZOOM_W / ZOOM_H
    ww = F.greatest(F.sqrt(area / ZOOM_TARGET * ZOOM_W / ZOOM_H), (x1 - x0) * 1.6, (y1 - y0) * 1.6 * ZOOM_W / ZOOM_H)
    wh = ww * ZOOM_H / ZOOM_W
    left = F.least(F.greatest((x0 + x1) / 2 - ww / 2, F.lit(0.0)), w - ww)
    top = F.least(F.greatest((y0 + y1) / 2 - wh / 2, F.lit(0.0)), h - wh)
    fits = (area / (w * h) < ZOOM_BELOW) & (ww < w) & (wh < h) & F.lit(aspect > 0)
    return F.when(fits, F.struct((left / w).alias("x0"), (top / h).alias("y0"), ((left + ww) / w).alias("x1"), ((top + wh) / h).alias("y1")))
