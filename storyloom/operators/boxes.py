"""Greedy operators over the boxes of a page; a page has tens of boxes, so each page is one array."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g


def filter_boxes(boxes: DataFrame, width: Column, height: Column, min_area: int = 3000, min_share: float = 0.0015, max_share: float = 0.95, min_side: int = 20, max_aspect: float = 4.0, min_confidence: float = 0.6) -> DataFrame:
    """boxes (box, confidence) of a sensible size and shape that do not touch the page's edges."""
    b, area, page = F.col("box"), g.area(F.col("box")), width.cast("double") * height
    sides = F.greatest(b["w"], b["h"]) / F.least(b["w"], b["h"])
    inside = (b["x"] > 0) & (b["y"] > 0) & (b["x"] + b["w"] < width) & (b["y"] + b["h"] < height)
    return boxes.where((area >= F.greatest(F.lit(float(min_area)), min_share * page)) & (area <= max_share * page) & (b["w"] >= min_side) & (b["h"] >= min_side) & (sides <= max_aspect) & (F.coalesce("confidence", F.lit(1.0)) >= min_confidence) & inside)


def suppress(boxes: Column, at_least: float = 0.5) -> Column:
    """Of an array of structs (box, id) those that no larger kept one holds or overlaps by IoU of at least that much;
    largest first, ties by id."""
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct((-g.area(b["box"])).alias("size"), b["id"].alias("id"), b["box"].alias("box"))))
    hit = lambda kept, b: F.exists(kept, lambda k: (g.iou(b["box"], k["box"]) >= at_least) | g.is_inside(b["box"], k["box"]))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(hit(kept, b), kept).otherwise(F.concat(kept, F.array(b))))


def iou_pairs(boxes: DataFrame, page: list[str], cell: int = 512) -> DataFrame:
    """Pairs of boxes of a page that overlap, with their IoU. Boxes meet on the columns of cells that they touch; a
    pair is taken in the first cell that both touch."""
    b = F.col("box")
    spread = boxes.select(*page, "id", "box", F.explode(F.sequence(F.floor(b["x"] / cell), F.floor((b["x"] + b["w"] - 1) / cell))).alias("__cell"))
    x, y = spread.alias("x"), spread.alias("y")
    on = (F.col("x.__cell") == F.col("y.__cell")) & (F.col("x.id") < F.col("y.id"))
    for k in page:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    first = F.floor(F.greatest(F.col("x.box.x"), F.col("y.box.x")) / cell) == F.col("x.__cell")
    met = x.join(y, on).where(first & (g.overlap_area(F.col("x.box"), F.col("y.box")) > 0))
    return met.select(*(F.col(f"x.{k}").alias(k) for k in page), F.col("x.id").alias("a"), F.col("y.id").alias("b"), g.iou(F.col("x.box"), F.col("y.box")).alias("iou"))


# Weights of the signals that choose the next box in a row.
READING = {"overlap": 2.0, "horizontal": 1.5, "vertical": 0.3, "distance": 0.5}


def order_of(boxes: list[dict], right_to_left: bool, row_share: float, w: dict) -> list[int]:
    """Positions of a page's boxes (x, y, w, h) in reading order."""
    sign = -1 if right_to_left else 1
    n = range(len(boxes))
    left, top = [float(b["x"]) for b in boxes], [float(b["y"]) for b in boxes]
    height = [float(b["h"]) for b in boxes]
    right, bottom = [float(b["x"] + b["w"]) for b in boxes], [float(b["y"] + b["h"]) for b in boxes]
    cx, cy = [(left[i] + right[i]) / 2 for i in n], [(top[i] + bottom[i]) / 2 for i in n]
    span, depth = max([1.0, *right]), max([1.0, *bottom])
    reach = (span**2 + depth**2) ** 0.5
    edge = right if right_to_left else [-x for x in left]
    unread, out = set(n), []

    def row_start() -> int:
        highest = min(top[i] for i in unread)
        return max((i for i in unread if top[i] == highest), key=lambda i: (edge[i], left[i] if right_to_left else -right[i], -i))

    def shared(i: int, j: int) -> float:
        return max(0.0, (min(bottom[i], bottom[j]) - max(top[i], top[j])) / min(height[i], height[j]))

    def merit(i: int, j: int) -> float:
        across = min(1.0, max(0.0, (sign * (cx[j] - cx[i]) / span + 1) / 2))
        down = min(1.0, max(0.0, (cy[j] - cy[i]) / depth))
        near = max(0.0, 1 - ((cx[j] - cx[i]) ** 2 + (cy[j] - cy[i]) ** 2) ** 0.5 / reach)
        return w["overlap"] * shared(i, j) + w["horizontal"] * across + w["vertical"] * down + w["distance"] * near

    while unread:
        ahead = [j for j in unread if shared(out[-1], j) >= row_share and sign * (cx[j] - cx[out[-1]]) > 0] if out else []
        out.append(max(ahead, key=lambda j: (merit(out[-1], j), edge[j], -j)) if ahead else row_start())
        unread.discard(out[-1])
    return out


def reading_order(boxes: DataFrame, page: list[str], right_to_left: bool = True, row_share: float = 0.5, weights: dict = READING) -> DataFrame:
    """page keys, id and rank (from 1) of each box (x, y, w, h). A row starts at the topmost box nearest the starting
    edge; then the best-scored box further along in the row is next. Boxes without a positive size have rank null."""
    pages = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "w", "h"))).alias("boxes"))
    ranked = T.StructType([T.StructField("id", boxes.schema["id"].dataType), T.StructField("rank", T.IntegerType())])
    schema = T.StructType([*(boxes.schema[k] for k in page), T.StructField("ranked", T.ArrayType(ranked))])

    def run(batches):
        for batch in batches:
            rows = []
            for group in batch.column(len(page)).to_pylist():
                fine = [b for b in group if None not in b.values() and b["w"] > 0 and b["h"] > 0]
                place = {i: r + 1 for r, i in enumerate(order_of(fine, right_to_left, row_share, weights))}
                rows.append([{"id": b["id"], "rank": place[i]} for i, b in enumerate(fine)] + [{"id": b["id"], "rank": None} for b in group if b not in fine])
            kind = pa.list_(pa.struct([("id", batch.column(len(page)).type.value_type.field("id").type), ("rank", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(page)], pa.array(rows, kind)], names=schema.names)

    return pages.mapInArrow(run, schema).select(*page, F.inline("ranked"))
