"""Scores: set similarity, confidence by state, closeness of pages, easing curves and keyframes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank and confidence factor of each verification state.
STATE_RANK = {"auto": 0, "uncertain": 1, "conflicted": 2, "verified": 3, "user_corrected": 4}
STATE_FACTOR = {"user_corrected": 1.0, "verified": 0.98, "auto": 0.85, "uncertain": 0.5, "conflicted": 0.35}


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; null if either is empty or null."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))


def coverage(needle: Column, hay: Column) -> Column:
    """Share of an array's distinct elements that another holds; 0 for an empty one."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)).cast("double") / F.size(F.array_distinct(needle))).otherwise(0.0)


def looked_up(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def effective_confidence(confidence: Column, state: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * looked_up(state, STATE_FACTOR, 0.8)


def page_boost(page: Column, at: Column, reach: float = 30.0) -> Column:
    """1 on the page itself, less by distance, 0 beyond reach or where either is unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(page - at) / F.lit(reach)), F.lit(0.0))


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (3.0 - 2.0 * u)


def zoom_rect(width: Column, height: Column, zoom: Column, cx: Column, cy: Column) -> Column:
    """The window that a zoom about a centre (shares of the sides) shows, kept inside."""
    w, h = width / F.greatest(zoom, F.lit(1.0)), height / F.greatest(zoom, F.lit(1.0))
    x = F.greatest(F.lit(0.0), F.least(cx * width - w / 2, width - w))
    y = F.greatest(F.lit(0.0), F.least(cy * height - h / 2, height - h))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


# Zoom at the start and end, and the centre's path (shares of width and height), of each camera move.
CAMERAS = {
    "static": (1.0, 1.0, 0.5, 0.5, 0.5, 0.5),
    "slow_zoom_in": (1.0, 1.25, 0.5, 0.5, 0.5, 0.5),
    "slow_zoom_out": (1.25, 1.0, 0.5, 0.5, 0.5, 0.5),
    "pan_left": (1.25, 1.25, 0.6, 0.5, 0.4, 0.5),
    "pan_right": (1.25, 1.25, 0.4, 0.5, 0.6, 0.5),
    "pan_up": (1.25, 1.25, 0.5, 0.6, 0.5, 0.4),
    "pan_down": (1.25, 1.25, 0.5, 0.4, 0.5, 0.6),
}


def keyframes(camera: Column, width: Column, height: Column, duration: Column, n: int = 12) -> Column:
    """array<struct<t, x, y, w, h>>: n frames of a camera move (unknown moves stand still), eased, rounded to 6 digits."""
    names = ("zoom0", "zoom1", "x0", "y0", "x1", "y1")
    move = lambda v: F.struct(*(F.lit(float(x)).alias(k) for k, x in zip(names, v)))
    moves = F.create_map(*(c for k, v in CAMERAS.items() for c in (F.lit(k), move(v))))
    # Each step binds what the next one uses, so that nothing is worked out twice.
    own = F.array(F.coalesce(F.try_element_at(moves, camera), move(CAMERAS["static"])))
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i / F.lit(float(max(1, n - 1)))).alias("u")))
    eased = F.transform(times, lambda f: F.struct(f["u"].alias("u"), smoothstep(f["u"]).alias("e")))

    def frames(m: Column) -> Column:
        between = lambda f, a, b: m[a] + (m[b] - m[a]) * f["e"]
        seen = F.transform(eased, lambda f: F.struct(f["u"].alias("u"), F.greatest(between(f, "zoom0", "zoom1"), F.lit(1.0)).alias("zoom"), between(f, "x0", "x1").alias("cx"), between(f, "y0", "y1").alias("cy")))
        sized = F.transform(seen, lambda f: F.struct(f["u"].alias("u"), (width / f["zoom"]).alias("w"), (height / f["zoom"]).alias("h"), f["cx"].alias("cx"), f["cy"].alias("cy")))
        inside = lambda c, side, of: F.greatest(F.lit(0.0), F.least(c * of - side / 2, of - side))
        return F.transform(sized, lambda f: F.struct(F.round(f["u"] * duration, 6).alias("t"), F.round(inside(f["cx"], f["w"], width), 6).alias("x"), F.round(inside(f["cy"], f["h"], height), 6).alias("y"), F.round(f["w"], 6).alias("w"), F.round(f["h"], 6).alias("h")))

    return F.element_at(F.transform(own, frames), 1)


def sample(frames: Column, t: Column) -> Column:
    """The rectangle at time t: linear between the keyframes around it, the end frames outside them."""
    before = F.try_element_at(F.filter(frames, lambda f: f["t"] <= t), F.lit(-1))
    after = F.try_element_at(F.filter(frames, lambda f: f["t"] > t), F.lit(1))
    a, b = F.coalesce(before, after), F.coalesce(after, before)
    u = F.coalesce(F.try_divide(t - a["t"], b["t"] - a["t"]), F.lit(0.0))
    u = F.when((t <= a["t"]) & before.isNull(), 0.0).otherwise(u)
    return F.struct(*((a[k] + (b[k] - a[k]) * u).alias(k) for k in "xywh"))
