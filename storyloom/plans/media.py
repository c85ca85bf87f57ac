"""Queries on time and space: timelines, cameras, boxes, sections, quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scoring as s
from ..operators import boxes as b
from ..operators import matching as m
from ..operators import rules
from ..operators import sequence as q
from ..operators import shots
from ..tables import spread
from .registry import query, table

_LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]
_LINE_W = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_KEY, F.col("l_quantity").alias("d"), "l_discount")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) OVER w - l_quantity, 4) AS start_time, round(sum(l_quantity) OVER w, 4) AS end_time FROM lineitem WINDOW w AS ({_LINE_W} ROWS UNBOUNDED PRECEDING)""")
def timeline(spark, sf_dir):
    return q.timeline(_lines(spark, sf_dir), ["l_orderkey"], _LINE_KEY, "d").select("l_orderkey", "l_linenumber", "l_partkey", "start_time", "end_time")


@query(f"""WITH n AS (SELECT *, lead(l_quantity) OVER ({_LINE_W}) AS nd FROM lineitem), t AS (SELECT *, CASE WHEN nd IS NULL THEN 0.0 ELSE least(0.3, 0.5 * least(l_quantity, nd), least(l_quantity, nd) / 2) END AS tr FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, nd AS next_duration, CAST(tr AS DOUBLE) AS transition FROM t""")
def pair_transitions(spark, sf_dir):
    out = q.transitions(_lines(spark, sf_dir), ["l_orderkey"], _LINE_KEY, "d")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "next_duration", "transition")


@query(f"""WITH n AS (SELECT *, lead(l_quantity) OVER ({_LINE_W}) AS nd FROM lineitem), t AS (SELECT *, CASE WHEN nd IS NULL THEN 0.0 ELSE least(0.3, 0.5 * least(l_quantity, nd)) END AS tr FROM n),
u AS (SELECT *, l_quantity - coalesce(lag(tr) OVER ({_LINE_W}), 0.0) AS step FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(sum(step) OVER w AS DOUBLE) - l_quantity, 4) AS start_time, round(CAST(sum(step) OVER w AS DOUBLE), 4) AS end_time FROM u WINDOW w AS ({_LINE_W} ROWS UNBOUNDED PRECEDING)""")
def timeline_overlap(spark, sf_dir):
    crossed = q.transitions(_lines(spark, sf_dir), ["l_orderkey"], _LINE_KEY, "d")
    return q.timeline(crossed, ["l_orderkey"], _LINE_KEY, "d", "transition").select("l_orderkey", "l_linenumber", "l_partkey", "start_time", "end_time")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS reuse_count FROM lineitem")
def shot_reuse(spark, sf_dir):
    out = shots.reuse(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("reuse_count").cast("long").alias("reuse_count"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(piece AS INTEGER) AS piece, round(CASE WHEN l_quantity <= 30 THEN l_quantity WHEN piece = 0 THEN greatest(3.0, l_quantity / 2) ELSE (l_quantity - greatest(3.0, l_quantity / 2)) / 2 END, 4)::DOUBLE AS piece_seconds
FROM lineitem, LATERAL (SELECT unnest(range(CASE WHEN l_quantity > 30 THEN 3 ELSE 1 END)) AS piece)""")
def long_split(spark, sf_dir):
    out = shots.split_long(table(spark, sf_dir, "lineitem"), "l_quantity", longest=30.0)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "piece", F.round("piece_seconds", 4).alias("piece_seconds"))


_EVENT_SQL = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 60 + CAST(floor(value) AS BIGINT) * 30 AS e, round(value, 2) AS v FROM events"


def _spans(spark, sf_dir):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("s"), (at + 60 + F.floor("value") * 30).alias("e"), F.round("value", 2).alias("v"))


@query(f"""WITH i AS ({_EVENT_SQL}), x AS (SELECT *, unnest(range(s // 900, (greatest(e, s + 1) - 1) // 900 + 1)) AS section FROM i),
y AS (SELECT *, least(e, (section + 1) * 900) - greatest(s, section * 900) AS inside FROM x)
SELECT event_type, section, count(*) AS n_parts, CAST(sum(inside) AS BIGINT) AS seconds, round(sum(v * inside) / sum(inside), 3) AS loudness FROM y GROUP BY ALL""")
def sections(spark, sf_dir):
    parts = q.sections(_spans(spark, sf_dir), F.col("s"), F.col("e"), 900)
    return shots.mix_sections(parts, ["event_type"], "inside", "v").select("event_type", "section", "n_parts", "seconds", F.round("loudness", 3).alias("loudness"))


@query("""WITH g AS (SELECT least(0.9 / max(abs(value / 100.0)), 1.009) AS gain FROM events) SELECT event_id, round(greatest(-1.0, least(1.0, value / 100.0 * gain)), 6) AS levelled FROM events, g""")
def normalize_two_pass(spark, sf_dir):
    out = shots.level(table(spark, sf_dir, "events").withColumn("x", F.col("value") / 100.0), "x")
    return out.select("event_id", F.round("levelled", 6).alias("levelled"))


_FRAMES_SQL = """WITH c AS (SELECT p_partkey, p_size + 10.0 AS w, p_size + 20.0 AS h, p_size + 1.0 AS dur, CASE p_size % 3 WHEN 0 THEN 1.25 ELSE 1.0 END AS z0, CASE p_size % 3 WHEN 0 THEN 1.25 WHEN 1 THEN 1.25 ELSE 1.0 END AS z1, CASE p_size % 3 WHEN 0 THEN 0.6 ELSE 0.5 END AS c0, CASE p_size % 3 WHEN 0 THEN 0.4 ELSE 0.5 END AS c1 FROM part),
f AS (SELECT *, unnest(range(12)) AS i FROM c), e AS (SELECT *, i / 11.0 AS u, (i / 11.0) * (i / 11.0) * (3.0 - 2.0 * (i / 11.0)) AS ease FROM f),
z AS (SELECT *, z0 + (z1 - z0) * ease AS zoom, c0 + (c1 - c0) * ease AS cx FROM e), r AS (SELECT *, w / zoom AS ww, h / zoom AS hh FROM z),
k AS (SELECT p_partkey, i, round(u * dur, 6) AS t, round(greatest(0.0, least(cx * w - ww / 2, w - ww)), 6) AS x, round(greatest(0.0, least(0.5 * h - hh / 2, h - hh)), 6) AS y, round(ww, 6) AS w, round(hh, 6) AS h FROM r)"""


def _frames(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "pan_left").when(F.col("p_size") % 3 == 1, "slow_zoom_in").otherwise("static")
    frames = s.keyframes(kind, F.col("p_size") + 10.0, F.col("p_size") + 20.0, F.col("p_size") + 1.0)
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), frames


@query(_FRAMES_SQL + " SELECT p_partkey, round(t, 4) AS t, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h FROM k")
def keyframes(spark, sf_dir):
    parts, frames = _frames(spark, sf_dir)
    # Inlined as they are made: of a column of their own, Spark would first test the size, and make them twice.
    return parts.select("p_partkey", F.inline(frames)).select("p_partkey", *(F.round(c, 4).alias(c) for c in "txywh"))


@query(_FRAMES_SQL + """, d AS (SELECT p_partkey, max(t) / 3 AS tm FROM k GROUP BY 1), a AS (SELECT d.p_partkey, tm, max(t) AS t0 FROM d JOIN k USING (p_partkey) WHERE t <= tm GROUP BY ALL), n AS (SELECT d.p_partkey, min(t) AS t1 FROM d JOIN k USING (p_partkey) WHERE t > tm GROUP BY ALL)
SELECT a.p_partkey, round(p.x + (n2.x - p.x) * (tm - t0) / (t1 - t0), 3) AS x, round(p.w + (n2.w - p.w) * (tm - t0) / (t1 - t0), 3) AS w FROM a JOIN n USING (p_partkey) JOIN k p ON p.p_partkey = a.p_partkey AND p.t = t0 JOIN k n2 ON n2.p_partkey = a.p_partkey AND n2.t = t1""")
def interpolate(spark, sf_dir):
    parts, made = _frames(spark, sf_dir)
    frames = parts.withColumn("frames", made).withColumn("r", s.sample(F.col("frames"), F.element_at("frames", -1)["t"] / 3))
    return frames.select("p_partkey", F.round("r.x", 3).alias("x"), F.round("r.w", 3).alias("w"))


_BOX_SQL = "SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, CAST(l_partkey % 600 AS INTEGER) AS x, CAST(l_suppkey % 400 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) * 8 + 20 AS w, CAST(l_quantity AS INTEGER) * 6 + 30 AS h FROM lineitem"


def _boxes(spark, sf_dir):
    """Lines of an order as boxes of a page."""
    w = q.Window.partitionBy("l_orderkey").orderBy(*_LINE_KEY, "l_extendedprice")
    n = F.col("l_quantity").cast("int")
    flat = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.row_number().over(w).cast("long").alias("id"), (F.col("l_partkey") % 600).cast("int").alias("x"), (F.col("l_suppkey") % 400).cast("int").alias("y"), (n * 8 + 20).alias("w"), (n * 6 + 30).alias("h"))
    return flat.withColumn("box", F.struct("x", "y", "w", "h"))


_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"WITH o AS ({_BOX_SQL}), p AS (SELECT a.page, a.id AS a, b.id AS b, {_INTER} AS i, a.w * a.h + b.w * b.h AS s FROM o a JOIN o b ON a.page = b.page AND a.id < b.id) SELECT page, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0")
def iou_pairs(spark, sf_dir):
    return b.iou_pairs(_boxes(spark, sf_dir), ["page"]).select("page", "a", "b", F.round("iou", 6).alias("iou"))


@query(f"""WITH o AS ({_BOX_SQL}), l AS (SELECT page, list({{'size': -w * h, 'id': id, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY -w * h, id) AS bs FROM o GROUP BY page),
k AS (SELECT page, list_reduce(list_transform(bs, lambda v: [v]), lambda kept, one: CASE WHEN len(list_filter(kept, lambda b:
 (greatest(0, least(b.x + b.w, one[1].x + one[1].w) - greatest(b.x, one[1].x)) * greatest(0, least(b.y + b.h, one[1].y + one[1].h) - greatest(b.y, one[1].y))) / CAST(b.w * b.h + one[1].w * one[1].h - greatest(0, least(b.x + b.w, one[1].x + one[1].w) - greatest(b.x, one[1].x)) * greatest(0, least(b.y + b.h, one[1].y + one[1].h) - greatest(b.y, one[1].y)) AS DOUBLE) >= 0.5
 OR (one[1].x >= b.x AND one[1].y >= b.y AND one[1].x + one[1].w <= b.x + b.w AND one[1].y + one[1].h <= b.y + b.h))) > 0 THEN kept ELSE list_concat(kept, one) END) AS kept FROM l)
SELECT page, unnest(list_transform(kept, lambda v: v.id)) AS id FROM k""")
def nms(spark, sf_dir):
    pages = _boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct("box", "id")).alias("boxes"))
    return pages.select("page", F.explode(F.transform(b.suppress(F.col("boxes")), lambda k: k["id"])).alias("id"))


#: A page's boxes as a list; each step takes the best of those ahead in the row of the last one, else the topmost of all.
_READING_SQL = f"""WITH RECURSIVE o AS ({_BOX_SQL}),
d AS (SELECT page, id, CAST(x AS DOUBLE) AS l, CAST(y AS DOUBLE) AS t, CAST(x + w AS DOUBLE) AS r, CAST(y + h AS DOUBLE) AS b, CAST(h AS DOUBLE) AS h, (x + (x + w)) / 2.0::DOUBLE AS cx, (y + (y + h)) / 2.0::DOUBLE AS cy FROM o),
p AS (SELECT page, greatest(1.0::DOUBLE, max(r)) AS span, greatest(1.0::DOUBLE, max(b)) AS depth, list({{'id': id, 'l': l, 't': t, 'r': r, 'b': b, 'h': h, 'cx': cx, 'cy': cy}} ORDER BY id) AS unread FROM d GROUP BY page),
s AS (SELECT page, span, depth, pow(pow(span, 2) + pow(depth, 2), 0.5::DOUBLE) AS reach, unread, CAST(NULL AS STRUCT(id BIGINT, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE, h DOUBLE, cx DOUBLE, cy DOUBLE)) AS box, 0 AS rank FROM p
UNION ALL SELECT page, span, depth, reach, list_filter(unread, lambda u: u.id <> pick.id), pick, rank + 1 FROM (
 SELECT *, CASE WHEN len(ahead) > 0 THEN list_sort(list_transform(ahead, lambda u: {{
  'm': 2.0::DOUBLE * greatest(0.0::DOUBLE, (least(box.b, u.b) - greatest(box.t, u.t)) / least(box.h, u.h)) + 1.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (-(u.cx - box.cx) / span + 1) / 2))
   + 0.3::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (u.cy - box.cy) / depth)) + 0.5::DOUBLE * greatest(0.0::DOUBLE, 1 - pow(pow(u.cx - box.cx, 2) + pow(u.cy - box.cy, 2), 0.5::DOUBLE) / reach), 'r': u.r, 'i': -u.id, 'u': u}}), 'DESC')[1].u
  ELSE list_sort(list_transform(unread, lambda u: {{'t': -u.t, 'r': u.r, 'l': u.l, 'i': -u.id, 'u': u}}), 'DESC')[1].u END AS pick FROM (
  SELECT *, list_filter(unread, lambda u: coalesce((least(box.b, u.b) - greatest(box.t, u.t)) / least(box.h, u.h) >= 0.5 AND u.cx < box.cx, false)) AS ahead FROM s WHERE len(unread) > 0)))
SELECT page, box.id AS id, rank FROM s WHERE rank > 0"""


@query(_READING_SQL)
def reading_order(spark, sf_dir):
    return b.reading_order(_boxes(spark, sf_dir), ["page"])


@query(f"""WITH o AS ({_BOX_SQL}) SELECT page, id, round(least(greatest(w, h * 16 / 9.0), 640.0, 480 * 16 / 9.0), 4)::DOUBLE AS crop_w, round(greatest(0.0, least(x + w / 2.0 - least(greatest(w, h * 16 / 9.0), 640.0, 480 * 16 / 9.0) / 2, 640 - least(greatest(w, h * 16 / 9.0), 640.0, 480 * 16 / 9.0))), 4)::DOUBLE AS crop_x FROM o""".replace("16 / 9.0", "CAST(16 AS DOUBLE) / 9"))
def crop_windows(spark, sf_dir):
    crop = g.aspect_crop(F.col("box"), F.lit(640), F.lit(480), 16 / 9)
    return _boxes(spark, sf_dir).withColumn("c", crop).select("page", "id", F.round("c.w", 4).alias("crop_w"), F.round("c.x", 4).alias("crop_x"))


_RULES = ("quantity positive", "discount sane", "ships in time", "status known")


@query("""WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT l_quantity > 0) AS a, count(*) FILTER (WHERE NOT l_discount <= 0.05) AS b, count(*) FILTER (WHERE NOT l_shipdate < TIMESTAMP '1998-01-01') AS c, count(*) FILTER (WHERE NOT l_linestatus IN ('O', 'F')) AS d FROM lineitem),
u AS (SELECT 'quantity positive' AS rule, true AS critical, n AS n_rows, a AS n_failed FROM r UNION ALL SELECT 'discount sane', false, n, b FROM r UNION ALL SELECT 'ships in time', true, n, c FROM r UNION ALL SELECT 'status known', true, n, d FROM r)
SELECT *, CASE WHEN n_failed = 0 THEN 'ok' WHEN critical THEN 'error' ELSE 'warning' END AS status FROM u""")
def quality_rules(spark, sf_dir):
    good = (F.col("l_quantity") > 0, F.col("l_discount") <= 0.05, F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.col("l_linestatus").isin("O", "F"))
    return rules.check(table(spark, sf_dir, "lineitem"), {n: (c, n != "discount sane") for n, c in zip(_RULES, good)})


@query("""WITH r AS (SELECT bool_or(NOT l_shipdate < TIMESTAMP '1998-01-01') AS late, bool_or(NOT l_discount <= 0.05) AS deep FROM lineitem) SELECT CASE WHEN late THEN 'error' WHEN deep THEN 'warning' ELSE 'ok' END AS status, CAST(2 + CASE WHEN late THEN 0 ELSE 1 END + CASE WHEN deep THEN 0 ELSE 1 END AS BIGINT) AS n_ok, CAST(4 AS BIGINT) AS n_rules FROM r""")
def quality_overall(spark, sf_dir):
    return rules.overall(quality_rules(spark, sf_dir))


@query(f"""WITH i AS ({_EVENT_SQL}), s AS (SELECT user_id, event_type, round(sum(v), 2) AS score FROM i GROUP BY ALL), r AS (SELECT *, lead(event_type) OVER w AS t2, lead(score) OVER w AS s2, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type))
SELECT user_id, event_type AS best, score AS best_score, CASE WHEN round(score - s2, 2) < 40 THEN t2 END AS second, coalesce(round(score - s2, 2) < 40, false) OR score < 700 AS needs_review FROM r WHERE n = 1""")
def planner_top2(spark, sf_dir):
    scored = _spans(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.sum("v"), 2).alias("score"))
    return m.best_two(scored, ["user_id"], "score", "event_type", 40.0, 700.0, digits=2)
