"""Column expressions over boxes, structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(bbox: Column) -> Column:
    """An array of four numbers as a box of ints; null unless all are finite numbers and the sides are positive."""
    n = [F.get(bbox, i).try_cast("double") for i in range(4)]
    fine = F.size(bbox) == 4
    for x in n:
        fine = fine & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)
    made = F.struct(*(x.cast("int").alias(k) for x, k in zip(n, "xywh")))
    return F.when(F.coalesce(fine & (n[2] > 0) & (n[3] > 0), F.lit(False)), made)


def area(a: Column) -> Column:
    return a["w"].cast("long") * a["h"]


def overlap_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), wide).cast("long") * F.greatest(F.lit(0), high)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for empty unions."""
    both = overlap_area(a, b)
    return F.coalesce(F.try_divide(both.cast("double"), area(a) + area(b) - both), F.lit(0.0))


def is_inside(a: Column, b: Column) -> Column:
    """Whether a lies within b."""
    return (a["x"] >= b["x"]) & (a["y"] >= b["y"]) & (a["x"] + a["w"] <= b["x"] + b["w"]) & (a["y"] + a["h"] <= b["y"] + b["h"])


def row_overlap(a: Column, b: Column) -> Column:
    """Shared height over the lesser height."""
    shared = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), shared.cast("double") / F.least(a["h"], b["h"]))


def clamp(a: Column, width: Column, height: Column) -> Column:
    """A box moved and cut so that it lies within width x height."""
    w, h = F.least(a["w"], width), F.least(a["h"], height)
    x = F.greatest(F.lit(0), F.least(a["x"], width - w))
    y = F.greatest(F.lit(0), F.least(a["y"], height - h))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def union_of(box: str) -> Column:
    """Aggregate: the least box around a group's boxes."""
    b = F.col(box)
    x, y = F.min(b["x"]), F.min(b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.max(b["x"] + b["w"]) - x).alias("w"), (F.max(b["y"] + b["h"]) - y).alias("h"))


def scaled(a: Column, by: Column) -> Column:
    """A box times a scale, rounded half to even."""
    return F.struct(*(F.bround(a[k] * by).cast("int").alias(k) for k in "xywh"))


def resolution(text: Column) -> Column:
    """"1280x720" as a struct w, h; null where it is none."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$", i), F.lit("")).cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("w"), part(2).alias("h")))


def clamped_scale(width: Column, height: Column, pixels: int) -> Column:
    """The scale, at most 1, that brings a page to at most so many pixels."""
    return F.least(F.lit(1.0), F.sqrt(F.lit(float(pixels)) / (width.cast("double") * height)))


def union_box(boxes: Column) -> Column:
    """The least box around an array of boxes; null for an empty array."""
    side = lambda k, s, most: (F.array_max if most else F.array_min)(F.transform(boxes, lambda b: b[k] + b[s] if s else b[k]))
    x, y = side("x", None, False), side("y", None, False)
    return F.when(F.size(boxes) > 0, F.struct(x.alias("x"), y.alias("y"), (side("x", "w", True) - x).alias("w"), (side("y", "h", True) - y).alias("h")))


def aspect_crop(a: Column, width: Column, height: Column, aspect: float) -> Column:
    """The least window of an aspect ratio around a box, centred on it, kept within width x height."""
    w = F.greatest(a["w"].cast("double"), a["h"] * F.lit(aspect))
    w = F.least(w, width.cast("double"), height * F.lit(aspect))
    h = w / aspect
    x = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"] / 2 - w / 2, width - w))
    y = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"] / 2 - h / 2, height - h))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
