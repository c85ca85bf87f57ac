"""Queries that plan crops: orders are panels, their lines the regions in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crops as c
from .registry import query, table

_KINDS = ("text", "face", "character", "object", "action", "effect")
_INTENTS = ("full_panel", "multi_panel", "smart_crop", "face_closeup", "character_closeup", "object_closeup", "action_crop", "sideways")

_PANELS_SQL = f"""panels AS (SELECT o_orderkey AS panel, CAST(200 + o_orderkey % 7 * 120 AS DOUBLE) AS width, CAST(200 + o_orderkey % 5 * 130 AS DOUBLE) AS height, list_element({list(_INTENTS)}, CAST(o_orderkey % 8 AS INTEGER) + 1) AS intent FROM orders)"""
_ENTRIES_SQL = f"""entries AS (SELECT l_orderkey AS panel, list_element({list(_KINDS)}, CAST((l_partkey + l_linenumber) % 6 AS INTEGER) + 1) AS kind, l_linenumber, l_partkey, l_suppkey,
 CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 300 AS DOUBLE) AS y, CAST(CASE WHEN l_quantity > 3 THEN l_quantity * 3 ELSE 0 END AS DOUBLE) AS w, CAST(l_quantity * 4 + 10 AS DOUBLE) AS h FROM lineitem WHERE l_returnflag <> 'A'),
labelled AS (SELECT *, kind || lpad(CAST(row_number() OVER (PARTITION BY panel, kind ORDER BY l_linenumber, l_partkey, l_suppkey) AS VARCHAR), 2, '0') AS label FROM entries),
known AS (SELECT panel, kind, label, 1.0::DOUBLE AS weight, x, y, w, h FROM labelled JOIN panels USING (panel) WHERE w > 0 AND h > 0 AND x + w <= width + 1e-6 AND y + h <= height + 1e-6),
blobs AS (SELECT l_orderkey AS panel, CASE WHEN l_linenumber % 3 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS weight, CAST(l_partkey % 420 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 310 AS DOUBLE) AS y, CAST(l_quantity + 4 AS DOUBLE) AS w, CAST(l_quantity * 2 + 6 AS DOUBLE) AS h, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'),
placed AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM blobs),
free AS (SELECT * FROM placed d WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.panel = d.panel AND greatest(0, least(d.x + d.w, k.x + k.w) - greatest(d.x, k.x)) * greatest(0, least(d.y + d.h, k.y + k.h) - greatest(d.y, k.y)) >= 0.8::DOUBLE * d.w * d.h)),
folded AS (SELECT panel, list_reduce(list([{{'place': place, 'weight': weight, 'x': x, 'y': y, 'w': w, 'h': h}}] ORDER BY place), lambda kept, d: CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(d[1].x + d[1].w, k.x + k.w) - greatest(d[1].x, k.x)) * greatest(0, least(d[1].y + d[1].h, k.y + k.h) - greatest(d[1].y, k.y)) >= 0.8::DOUBLE * d[1].w * d[1].h)) > 0 THEN kept ELSE list_concat(kept, d) END) AS kept FROM free GROUP BY panel),
drawn AS (SELECT panel, unnest(kept) AS d FROM folded),
every AS (SELECT panel, kind, label, weight, x, y, w, h, 'metadata' AS source FROM known UNION ALL SELECT panel, 'draw', 'draw' || lpad(CAST(d.place AS VARCHAR), 2, '0'), d.weight, d.x, d.y, d.w, d.h, 'edge' FROM drawn),
regions AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY weight DESC, label DESC) AS position FROM every)"""


def _panels(spark, sf_dir):
    o = F.col("o_orderkey")
    intent = F.element_at(F.array(*map(F.lit, _INTENTS)), (o % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(o.alias("panel"), (200 + o % 7 * 120).cast("double").alias("width"), (200 + o % 5 * 130).cast("double").alias("height"), intent.alias("intent"))


def _regions(spark, sf_dir):
    """The lists of a panel's record, as a model leaves them, and what a detector drew."""
    lines = table(spark, sf_dir, "lineitem")
    n, key = F.col("l_quantity"), ["l_linenumber", "l_partkey", "l_suppkey"]
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    bbox = F.array((F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") * 7 % 300).cast("double"), F.when(n > 3, n * 3).otherwise(0.0), n * 4 + 10)
    entry = F.struct(*key, bbox.alias("bbox"), kind.alias("kind"))
    found = lines.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("panel"), entry.alias("entry")).groupBy("panel").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    records = found.select("panel", *(F.filter("entries", lambda e: e["kind"] == k).alias(k) for k in _KINDS))
    known = c.metadata_lists(records, ["panel"], {k: k for k in _KINDS})
    blobs = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("panel"), F.struct(*key).alias("place"), F.when(F.col("l_linenumber") % 3 == 0, 0.75).otherwise(0.5).alias("weight"), (F.col("l_partkey") % 420).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 310).cast("double").alias("y"), (n + 4).alias("w"), (n * 2 + 6).alias("h"))
    return known, blobs, _panels(spark, sf_dir), ["panel"]


def _shots(spark, sf_dir):
    return _panels(spark, sf_dir).join(c.lists_gathered(*_regions(spark, sf_dir)), "panel", "left")


@query(f"WITH {_PANELS_SQL}, {_ENTRIES_SQL} SELECT panel, kind, label, weight, x, y, w, h, source, position FROM regions")
def panel_regions(spark, sf_dir):
    return c.lists_gathered(*_regions(spark, sf_dir)).select("panel", F.inline("regions")).withColumn("position", F.col("position").cast("long"))


_FOCUS_SQL = """tiers AS (SELECT * FROM (VALUES ('face_closeup', 'face', 0), ('face_closeup', 'character', 1), ('character_closeup', 'character', 0), ('character_closeup', 'face', 0), ('object_closeup', 'object', 0), ('object_closeup', 'draw', 1), ('action_crop', 'action', 0), ('action_crop', 'draw', 1)) AS t(intent, kind, tier)),
looked AS (SELECT p.panel, r.*, coalesce(tier, 9) AS tier FROM panels p JOIN regions r ON r.panel = p.panel LEFT JOIN tiers t ON t.intent = p.intent AND t.kind = r.kind WHERE p.intent IN ('face_closeup', 'character_closeup', 'object_closeup', 'action_crop')),
focus AS (SELECT * FROM looked QUALIFY row_number() OVER (PARTITION BY panel ORDER BY tier, weight DESC, CASE WHEN tier < 9 THEN w * h ELSE 0 END, position) = 1)"""


@query(f"WITH {_PANELS_SQL}, {_ENTRIES_SQL}, {_FOCUS_SQL} SELECT p.panel, p.intent, f.kind, f.position FROM panels p LEFT JOIN focus f USING (panel)")
def focus_regions(spark, sf_dir):
    shots = _shots(spark, sf_dir).withColumn("f", c.focus(F.col("intent"), F.col("regions")))
    return shots.select("panel", "intent", "f.kind", F.col("f.position").cast("long").alias("position"))


_A = "(16.0::DOUBLE / 9)"
_FIT = "least(greatest({c}, {w} / 2), {W} - {w} / 2) - {w} / 2"
_CROP_SQL = f"""{_FOCUS_SQL},
critical AS (SELECT * FROM regions WHERE weight >= 0.6::DOUBLE - 1e-6),
spread AS (SELECT panel, min(x) AS x, min(y) AS y, least(max(x + w) - min(x), any_value(width)) AS w, least(max(y + h) - min(y), any_value(height)) AS h, any_value(width) AS width, any_value(height) AS height FROM critical JOIN panels USING (panel) GROUP BY panel),
edges AS (SELECT panel, greatest(0, least(x, width - w)) AS x, greatest(0, least(y, height - h)) AS y, w, h FROM spread),
must AS (SELECT p.panel, p.width, p.height, p.intent, f.panel IS NOT NULL AS close, coalesce(f.x, e.x) AS x, coalesce(f.y, e.y) AS y, coalesce(f.w, e.w) AS w, coalesce(f.h, e.h) AS h, width / height >= {_A} AS wide FROM panels p LEFT JOIN focus f USING (panel) LEFT JOIN edges e USING (panel)),
cl AS (SELECT *, CASE WHEN least(greatest(w, h * {_A}), width) / {_A} > height THEN height * {_A} ELSE least(greatest(w, h * {_A}), width) END AS cw, CASE WHEN least(greatest(w, h * {_A}), width) / {_A} > height THEN height ELSE least(greatest(w, h * {_A}), width) / {_A} END AS ch FROM must WHERE close),
closeup AS (SELECT panel, greatest(0, least({_FIT.format(c='x + w / 2', w='cw', W='width')}, width - cw)) AS ox, greatest(0, least({_FIT.format(c='y + h / 2', w='ch', W='height')}, height - ch)) AS oy, cw AS bw, ch AS bh FROM cl),
room AS (SELECT *, CASE WHEN wide THEN height * {_A} ELSE width END AS bw, CASE WHEN wide THEN height ELSE width / {_A} END AS bh, CASE WHEN wide THEN x ELSE y END AS start, CASE WHEN wide THEN w ELSE h END AS size, CASE WHEN wide THEN height * {_A} ELSE width / {_A} END AS len FROM must WHERE NOT close),
places AS (SELECT *, unnest(CASE WHEN size <= len + 1e-6 THEN [0.0::DOUBLE, start, start + size - len, start + size / 2 - len / 2] ELSE [0.0::DOUBLE] END) AS place, generate_subscripts(CASE WHEN size <= len + 1e-6 THEN [0, 1, 2, 3] ELSE [0] END, 1) AS rank FROM room),
cand AS (SELECT panel, rank, CASE WHEN wide THEN greatest(0, least(place, width - bw)) ELSE 0 END AS ox, CASE WHEN wide THEN 0 ELSE greatest(0, least(place, height - bh)) END AS oy, bw, bh FROM places),
part AS (SELECT c.panel, c.rank, c.ox, c.oy, c.bw, c.bh, r.position, r.weight, r.weight >= 0.6::DOUBLE - 1e-6 AS crit, greatest(0, least(c.ox + c.bw, r.x + r.w) - greatest(c.ox, r.x)) * greatest(0, least(c.oy + c.bh, r.y + r.h) - greatest(c.oy, r.y)) / (r.w * r.h + 1e-6) AS share, pow(c.ox + c.bw / 2 - r.x - r.w / 2, 2) + pow(c.oy + c.bh / 2 - r.y - r.h / 2, 2) AS far FROM cand c LEFT JOIN regions r USING (panel)),
scored AS (SELECT panel, rank, ox, oy, bw, bh, count(*) FILTER (WHERE crit AND share <= 0.999) AS cut, coalesce(list_reduce(list(weight * share ORDER BY position) FILTER (WHERE position IS NOT NULL), lambda a, b: a + b), 0) AS score, coalesce(min(far) FILTER (WHERE crit), 0) AS far FROM part GROUP BY ALL),
best AS (SELECT panel, ox, oy, bw, bh FROM scored QUALIFY row_number() OVER (PARTITION BY panel ORDER BY cut, score DESC, far, rank) = 1),
win AS (SELECT * FROM closeup UNION ALL SELECT * FROM best),
judged AS (SELECT m.*, ox, oy, bw, bh, m.x IS NULL OR (ox - 1e-6 <= m.x AND oy - 1e-6 <= m.y AND m.x + m.w <= ox + bw + 1e-6 AND m.y + m.h <= oy + bh + 1e-6) AS seen, least(bw, bh) < 0.6::DOUBLE * least(width, height) - 1e-6 AS small FROM must m JOIN win USING (panel)),
named AS (SELECT *, CASE WHEN intent IN ('full_panel', 'multi_panel') OR (seen AND small) THEN 'full_panel' WHEN seen THEN '16_9' ELSE 'safe_wider' END AS strategy, 0.06::DOUBLE * least(width, height) AS pad FROM judged),
kept AS (SELECT * EXCLUDE (x, y), CASE WHEN x IS NOT NULL THEN greatest(0, least(x, width - w)) END AS x, CASE WHEN x IS NOT NULL THEN greatest(0, least(y, height - h)) END AS y FROM named),
padded AS (SELECT *, greatest(0, x - pad) AS px, greatest(0, y - pad) AS py, least(width, x + w + pad) - greatest(0, x - pad) AS pw, least(height, y + h + pad) - greatest(0, y - pad) AS ph FROM kept),
steps AS (SELECT *, unnest([{_A}, 4.0::DOUBLE / 3, 1.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE / 3, 0.75::DOUBLE]) AS ratio, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS step FROM padded WHERE x IS NOT NULL),
sized AS (SELECT *, CASE WHEN pw / ph > ratio + 1e-6 THEN pw ELSE ph * ratio END AS nw, CASE WHEN pw / ph > ratio + 1e-6 THEN pw / ratio ELSE ph END AS nh FROM steps),
rung AS (SELECT panel, step, nw, nh, greatest(0, least(px + pw / 2 - nw / 2, width - nw)) AS nx, greatest(0, least(py + ph / 2 - nh / 2, height - nh)) AS ny FROM sized WHERE nw <= width + 1e-6 AND nh <= height + 1e-6 QUALIFY row_number() OVER (PARTITION BY panel ORDER BY step) = 1),
lad AS (SELECT p.panel, coalesce(step, 0) AS step, coalesce(nx, px) AS nx, coalesce(ny, py) AS ny, coalesce(nw, pw) AS nw, coalesce(nh, ph) AS nh FROM padded p LEFT JOIN rung USING (panel) WHERE p.x IS NOT NULL)"""


@query(f"""WITH {_PANELS_SQL}, {_ENTRIES_SQL}, {_CROP_SQL} SELECT panel, intent, strategy, CASE strategy WHEN 'full_panel' THEN abs(width / height - {_A}) > 0.01 ELSE strategy = 'safe_wider' END AS letterbox,
 round(CASE strategy WHEN 'full_panel' THEN 0 WHEN '16_9' THEN ox ELSE nx END, 4) AS x, round(CASE strategy WHEN 'full_panel' THEN 0 WHEN '16_9' THEN oy ELSE ny END, 4) AS y,
 round(CASE strategy WHEN 'full_panel' THEN width WHEN '16_9' THEN bw ELSE nw END, 4) AS w, round(CASE strategy WHEN 'full_panel' THEN height WHEN '16_9' THEN bh ELSE nh END, 4) AS h FROM padded LEFT JOIN lad USING (panel)""")
def crop_search(spark, sf_dir):
    return c.planned(_shots(spark, sf_dir)).select("panel", "intent", "strategy", "letterbox", *(F.round(k, 4).alias(k) for k in "xywh"))


@query(f"""WITH {_PANELS_SQL}, {_ENTRIES_SQL}, {_CROP_SQL} SELECT panel, round(nx, 4) AS x, round(ny, 4) AS y, round(nw, 4) AS w, round(nh, 4) AS h FROM lad WHERE panel NOT IN (SELECT panel FROM focus)""")
def ratio_ladder(spark, sf_dir):
    """The wider box around what is critical, for every panel that is no close-up of a region."""
    shots = _shots(spark, sf_dir).where(c.focus(F.col("intent"), F.col("regions")).isNull())
    width, height = F.col("width"), F.col("height")
    critical = F.array(F.filter("regions", lambda r: r["weight"] >= 0.6 - c.SLACK))
    boxes = F.transform(F.filter(critical, lambda r: F.size(r) > 0), lambda r: c.around(r, width, height))
    # Exploded, not filtered: a filter would move below the regions and work them out again.
    out = shots.select("panel", F.explode(F.transform(boxes, lambda b: c.ladder(b, width, height))).alias("b"))
    return out.select("panel", *(F.round(f"b.{k}", 4).alias(k) for k in "xywh"))
