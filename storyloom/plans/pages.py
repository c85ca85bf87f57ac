"""Queries on single rows and pages: validation, coercion, texts, prompts, boxes, word lines, ordered panels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import scoring as s
from ..functions import text as t
from ..operators import extraction as x
from ..operators import knowledge as k
from ..operators import retrieval as r
from ..operators import rules, shots
from ..sources import readers, sinks
from .registry import query, table

_KEY_W = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _lines(spark, sf_dir):
    """Lines of an order, numbered: the panels of a page."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))


@query(f"""WITH l AS (SELECT *, CAST(row_number() OVER ({_KEY_W}) AS INTEGER) AS n FROM lineitem),
p AS (SELECT l_orderkey, n, CASE WHEN l_orderkey % 1100 < 1000 THEN printf('p%03d_%03d', l_orderkey % 1100, n) ELSE 'p' || (l_orderkey % 1100) END AS panel_id, CAST(l_orderkey % 5 AS INTEGER) AS page, CAST(l_linenumber - 1 AS INTEGER) AS ord, l_discount * 11 AS conf, CAST(l_quantity AS INTEGER) - 3 AS w, CAST(l_partkey % 4 AS INTEGER) - 1 AS x FROM l)
SELECT l_orderkey, n, panel_id, list_aggregate(list_filter([CASE WHEN NOT regexp_full_match(panel_id, 'p\\d{{3}}_\\d{{3}}') THEN 'panel_id' END, CASE WHEN page < 1 THEN 'page' END, CASE WHEN ord < 1 THEN 'reading_order' END, CASE WHEN w <= 0 OR x < 0 THEN 'bbox' END, CASE WHEN conf > 1 THEN 'confidence' END], lambda v: v IS NOT NULL), 'string_agg', ',') AS errors FROM p""")
def panel_validation(spark, sf_dir):
    page = F.col("l_orderkey") % 1100
    rows = _lines(spark, sf_dir).select(
        "l_orderkey", "n", F.when(page < 1000, F.format_string("p%03d_%03d", page, "n")).otherwise(F.concat(F.lit("p"), page.cast("string"))).alias("panel_id"), (F.col("l_orderkey") % 5).cast("int").alias("page"), (F.col("l_linenumber") - 1).alias("reading_order"),
        F.array((F.col("l_partkey") % 4 - 1).cast("int"), F.lit(0), F.col("l_quantity").cast("int") - 3, F.lit(5)).alias("bbox"), F.struct((F.col("l_discount") * 11).alias("confidence")).alias("visual"),
    )
    return rows.select("l_orderkey", "n", "panel_id", F.nullif(F.array_join(k.panel_errors(), ","), F.lit("")).alias("errors"))


@query("""WITH p AS (SELECT l_orderkey AS page, count(*) AS n, max(l_linenumber) AS panel_count, CASE min(l_linestatus) WHEN 'O' THEN 'rtl' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'ltr' ELSE 'up' END END AS reading_direction FROM lineitem GROUP BY l_orderkey)
SELECT page, n <> panel_count AS wrong_count, reading_direction = 'up' AS wrong_direction FROM p WHERE n <> panel_count OR reading_direction = 'up'""")
def page_validation(spark, sf_dir):
    status = F.when(F.min("l_linestatus") == "O", "rtl").otherwise(F.when(F.col("l_orderkey") % 2 == 0, "ltr").otherwise("up"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("panels"), F.max("l_linenumber").alias("panel_count"), status.alias("reading_direction"))
    found = k.page_errors(pages.withColumnRenamed("l_orderkey", "page"))
    return found.select("page", F.array_contains("errors", "panel_count").alias("wrong_count"), F.array_contains("errors", "direction").alias("wrong_direction"))


_BOX = "CAST(l_partkey % 600 AS INTEGER) - 20 AS x, CAST(l_suppkey % 400 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) * 20 - 60 AS w, CAST(l_quantity AS INTEGER) * 12 AS h"


def _raw_boxes(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    sides = [(F.col("l_partkey") % 600).cast("int") - 20, (F.col("l_suppkey") % 400).cast("int"), q * 20 - 60, q * 12]
    return _lines(spark, sf_dir).select("l_orderkey", "n", g.box(F.array(*sides)).alias("box"))


@query(f"""WITH b AS (SELECT l_orderkey, CAST(row_number() OVER ({_KEY_W}) AS INTEGER) AS n, {_BOX} FROM lineitem), v AS (SELECT *, least(w, 640) AS cw, least(h, 480) AS ch FROM b WHERE w > 0 AND h > 0)
SELECT l_orderkey, n, x >= 0 AND y >= 0 AND x + w <= 640 AND y + h <= 480 AS inside, greatest(0, least(x, 640 - cw)) AS cx, greatest(0, least(y, 480 - ch)) AS cy, cw, ch, CAST(round_even(x / 2.0, 0) AS INTEGER) AS half_x FROM v""")
def box_clamps(spark, sf_dir):
    fine = _raw_boxes(spark, sf_dir).where("box is not null")
    page = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(640).alias("w"), F.lit(480).alias("h"))
    c = fine.withColumn("c", g.clamp(F.col("box"), F.lit(640), F.lit(480)))
    return c.select("l_orderkey", "n", g.is_inside(F.col("box"), page).alias("inside"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"), g.scaled(F.col("box"), F.lit(0.5))["x"].alias("half_x"))


@query(f"""WITH b AS (SELECT l_orderkey, {_BOX} FROM lineitem) SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM b WHERE w > 0 AND h > 0 GROUP BY 1""")
def union_boxes(spark, sf_dir):
    pages = _raw_boxes(spark, sf_dir).where("box is not null").groupBy("l_orderkey").agg(g.union_of("box").alias("u"), F.count("*").alias("n"))
    return pages.select("l_orderkey", "u.*", "n")


@query(f"""WITH b AS (SELECT l_orderkey, CAST(row_number() OVER ({_KEY_W}) AS INTEGER) AS n, {_BOX} FROM lineitem), p AS (SELECT a.l_orderkey, a.n, a.y AS ay, a.h AS ah, b.y AS by_, b.h AS bh FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND b.n = a.n + 1 WHERE a.w > 0 AND b.w > 0)
SELECT l_orderkey, n, round(greatest(0.0, CAST(least(ay + ah, by_ + bh) - greatest(ay, by_) AS DOUBLE) / least(ah, bh)), 6) AS shared FROM p""")
def row_overlaps(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("n")
    near = _raw_boxes(spark, sf_dir).withColumn("b", F.lead("box").over(w)).where("box is not null and b is not null")
    return near.select("l_orderkey", "n", F.round(g.row_overlap(F.col("box"), F.col("b")), 6).alias("shared"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'slow_zoom_in' WHEN 1 THEN 'slow_zoom_out' WHEN 2 THEN 'pan_left' WHEN 3 THEN 'spin' END AS camera, CASE event_id % 4 WHEN 0 THEN 'smart_crop' WHEN 1 THEN 'full_panel' WHEN 2 THEN 'sideways' END AS intent, value / 60 AS story FROM events)
SELECT event_id, CASE camera WHEN 'slow_zoom_out' THEN 1.25 ELSE 1.0 END::DOUBLE AS zoom_start, CASE camera WHEN 'slow_zoom_in' THEN 1.25 ELSE 1.0 END::DOUBLE AS zoom_end, CASE WHEN intent IN ('smart_crop', 'full_panel') THEN intent ELSE 'smart_crop' END AS intent, round(CASE WHEN story BETWEEN 0 AND 1 THEN story ELSE 0.0 END, 6)::DOUBLE AS story FROM c""")
def camera_plans(spark, sf_dir):
    m = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", m(5, "slow_zoom_in", "slow_zoom_out", "pan_left", "spin", None).alias("camera"), m(4, "smart_crop", "full_panel", "sideways", None).alias("intent"), (F.col("value") / 60).alias("story"))
    zoom = k.camera_zoom(F.col("camera"))
    return rows.select("event_id", zoom["start"].alias("zoom_start"), zoom["end"].alias("zoom_end"), k.valid_intent(F.col("intent")).alias("intent"), F.round(k.unit_or(F.col("story"), 0.0), 6).alias("story"))


_SEG_SQL = """WITH s AS (SELECT user_id AS scene_id, event_id AS position, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'Narration: page ' || event_id ELSE '"line ' || event_id || '"' END AS text, floor(value) - 3 AS seconds, CASE event_type WHEN 'view' THEN 'narration' WHEN 'click' THEN 'dialogue' WHEN 'signup' THEN 'song' ELSE 'narration' END AS type, CASE WHEN event_id % 4 = 0 THEN 'Aki' END AS speaker FROM events)"""


@query(_SEG_SQL + """, v AS (SELECT *, text <> '' AND seconds > 0 AND type <> 'song' AS fine FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY position) AS n FROM v WHERE fine)
SELECT scene_id, printf('seg_%03d', n) AS segment_id, type, CASE WHEN text LIKE 'Narration: %' THEN substr(text, 12) ELSE trim(text, '"') END AS text, seconds AS estimated_seconds, CASE WHEN type = 'dialogue' THEN coalesce(speaker, 'unknown') END AS speaker FROM g""")
def narration_segments(spark, sf_dir):
    good, _ = _segments(spark, sf_dir)
    return good.select("scene_id", "segment_id", "type", "text", "estimated_seconds", "speaker")


@query(_SEG_SQL + " SELECT scene_id, position, concat_ws(',', CASE WHEN text = '' THEN 'text' END, CASE WHEN NOT seconds > 0 THEN 'seconds' END, CASE WHEN type = 'song' THEN 'type' END) AS errors FROM s WHERE text = '' OR NOT seconds > 0 OR type = 'song'")
def rejected_segments(spark, sf_dir):
    _, bad = _segments(spark, sf_dir)
    return bad.select("scene_id", "position", F.array_join("errors", ",").alias("errors"))


def _segments(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scene_id"), i.alias("position"), F.when(i % 9 == 0, "").when(i % 9 == 1, F.concat(F.lit("Narration: page "), i.cast("string"))).otherwise(F.concat(F.lit('"line '), i.cast("string"), F.lit('"'))).alias("text"), F.array(F.lit("p001_001")).alias("panel_ids"),
        (F.floor("value") - 3).cast("string").alias("estimated_seconds"), F.lit(None).cast("string").alias("visual_intent"), F.lit(None).cast("string").alias("camera"), F.lit(None).cast("string").alias("importance"), F.when(kind == "click", "dialogue").when(kind == "signup", "song").otherwise("narration").alias("type"), F.when(i % 4 == 0, "Aki").alias("speaker"),
    )
    known = raw.select("scene_id").distinct().withColumn("ids", F.array(F.lit("p001_001")))
    return k.segments(raw, known)


@query(_SEG_SQL + """ SELECT scene_id, md5(string_agg(CASE WHEN type = 'dialogue' THEN 'Dialogue' || coalesce(' (' || speaker || ')', '') ELSE 'Narrator' END || ': ' || text, chr(10) ORDER BY position)) AS script_md5 FROM s GROUP BY 1""")
def narration_scripts(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene_id"), i.alias("position"), F.when(kind == "click", "dialogue").otherwise("narration").alias("type"), F.when(i % 4 == 0, "Aki").alias("speaker"), F.when(i % 9 == 0, "").when(i % 9 == 1, F.concat(F.lit("Narration: page "), i.cast("string"))).otherwise(F.concat(F.lit('"line '), i.cast("string"), F.lit('"'))).alias("text"))
    return sinks.narration_text(rows, ["scene_id"]).select("scene_id", F.md5("script").alias("script_md5"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' v' || (p_partkey % 30) || ' (Digital)' WHEN 1 THEN p_name || ' Vol. ' || (p_partkey % 30) || '.pdf' WHEN 2 THEN p_name || ' (2014)' WHEN 3 THEN p_name || ' (Scan Group) Chapter 12-14' WHEN 4 THEN p_name || ' -' ELSE p_name END AS title, p_name FROM part)
SELECT p_partkey, p_name AS stripped, CAST(CASE WHEN p_partkey % 6 IN (0, 1) THEN p_partkey % 30 ELSE 0 END AS INTEGER) AS volume, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS title_key FROM t""")
def title_parts(spark, sf_dir):
    n, v, name = F.col("p_partkey") % 6, (F.col("p_partkey") % 30).cast("string"), F.col("p_name")
    title = F.when(n == 0, F.concat(name, F.lit(" v"), v, F.lit(" (Digital)"))).when(n == 1, F.concat(name, F.lit(" Vol. "), v, F.lit(".pdf"))).when(n == 2, F.concat(name, F.lit(" (2014)"))).when(n == 3, F.concat(name, F.lit(" (Scan Group) Chapter 12-14"))).when(n == 4, F.concat(name, F.lit(" -"))).otherwise(name)
    rows = table(spark, sf_dir, "part").withColumn("title", title)
    return rows.select("p_partkey", t.strip_volume(F.col("title")).alias("stripped"), t.volume_number(F.col("title")).alias("volume"), t.title_key(t.strip_volume(F.col("title"))).alias("title_key"))


@query("""SELECT c_custkey, c_name AS normalized, c_custkey % 4 = 3 AS unknown, 'c' || c_custkey || ', ' || c_mktsegment AS line FROM customer""")
def person_names(spark, sf_dir):
    n, name = F.col("c_custkey") % 4, F.col("c_name")
    written = F.when(n == 0, F.concat(name, F.lit("'s"))).when(n == 1, F.concat(F.lit('"'), name, F.lit('" (hero)'))).when(n == 2, F.concat(F.lit("  "), name)).otherwise(name)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", written.alias("name"), F.when(n == 3, F.lit("Unknown person")).otherwise(written).alias("seen"))
    return rows.select("c_custkey", t.normalize_name(F.col("name")).alias("normalized"), t.is_unknown_name(F.col("seen")).alias("unknown"), F.concat_ws(", ", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "c_mktsegment").alias("line"))


@query("""WITH l AS (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS pos, unnest(string_split(html, chr(10))) AS line FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(line, '<[^>]*>', ' ', 'g'), '[ \\t\\r]+', ' ', 'g')) AS heading FROM l WHERE regexp_matches(line, '<h[1-6]')""")
def clean_headings(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line")).where(F.col("line").rlike("<h[1-6]"))
    return lines.select("page_id", "pos", x.clean_heading(F.col("line")).alias("heading"))


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?:src|href)="([^"]+)"', 1) AS links FROM pages) SELECT page_id, list_filter(links, lambda v: NOT regexp_matches(lower(v), 'logo|icon|wiki'))[1] AS portrait, CAST(len(links) AS INTEGER) AS n_links FROM p""")
def portrait_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('(?:src|href)="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", x.first_link(links, ("logo", "icon", "wiki")).alias("portrait"), F.size(links).alias("n_links"))


_MARKS_SQL = r"""WITH c AS (SELECT conv_id AS work, CAST(turn AS INTEGER) AS page, conv_id % 5 AS n_panels, CAST(turn + conv_id % 4 AS VARCHAR) AS k, text, conv_id FROM conversations WHERE text IS NOT NULL),
h AS (SELECT work, page, n_panels, trim(regexp_replace(CASE conv_id % 6 WHEN 0 THEN 'Chapter ' || k || ' ' WHEN 1 THEN 'Chapter ' || k || ': ' WHEN 2 THEN '第' || k || '話 ' WHEN 3 THEN '#' || k || ' Bold ' WHEN 4 THEN substr(text, 1, 60) || 'Vol. 2 Ch ' || k || ' ' ELSE '' END || text, '\s+', ' ', 'g')) AS t FROM c),
m AS (SELECT *, 1 AS way, regexp_extract(t, '(?is)^(.*?)(?:chapter|chap\.?|ch\.?|ch)\s*#?\s*\d+', 1) AS before, regexp_extract(t, '(?is)(?:chapter|chap\.?|ch\.?|ch)\s*#?\s*(\d+)', 1) AS n, regexp_extract(t, '(?is)(?:chapter|chap\.?|ch\.?|ch)\s*#?\s*(\d+)(?:\s*[:\-–]\s*(.+))?', 2) AS title FROM h
UNION ALL SELECT *, 2, regexp_extract(t, '(?s)^(.*?)#\s*\d+', 1), regexp_extract(t, '#\s*(\d+)', 1), regexp_extract(t, '#\s*(\d+)(?:\s+([A-Z].+))?', 2) FROM h
UNION ALL SELECT *, 3, regexp_extract(t, '(?s)^(.*?)第\s*\d+\s*[話回章]', 1), regexp_extract(t, '第\s*(\d+)\s*[話回章]', 1), '' FROM h
UNION ALL SELECT *, 4, regexp_extract(t, '(?is)^(.*?)(?:volume|vol\.?|v\.?)\s*\d+\s+(?:chapter|ch\.?|ch)\s*\d+', 1), regexp_extract(t, '(?is)(?:volume|vol\.?|v\.?)\s*(\d+)\s+(?:chapter|ch\.?|ch)\s*(\d+)', 1), regexp_extract(t, '(?is)(?:volume|vol\.?|v\.?)\s*(\d+)\s+(?:chapter|ch\.?|ch)\s*(\d+)', 2) FROM h)"""


def _headed_pages(spark, sf_dir):
    """Turns as pages, five in six headed in one of the ways to write a chapter."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    k = (F.col("turn") + F.col("conv_id") % 4).cast("string")
    heads = [F.concat(F.lit("Chapter "), k, F.lit(" ")), F.concat(F.lit("Chapter "), k, F.lit(": ")), F.concat(F.lit("第"), k, F.lit("話 ")), F.concat(F.lit("#"), k, F.lit(" Bold ")), F.concat(F.substring("text", 1, 60), F.lit("Vol. 2 Ch "), k, F.lit(" ")), F.lit("")]
    head = F.element_at(F.array(*heads), (F.col("conv_id") % 6 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("work"), F.col("turn").cast("int").alias("page"), (F.col("conv_id") % 5).alias("n_panels"), F.concat(head, F.col("text")).alias("text"))


@query(_MARKS_SQL + """ SELECT work, page, CAST(n AS INTEGER) AS number, substr(trim(title), 1, 30) AS title, least(0.95, CASE WHEN trim(title) <> '' THEN 0.7 ELSE 0.5 END + CASE WHEN length(before) / CAST(length(t) AS DOUBLE) < 0.3 THEN 0.1 ELSE 0 END)::DOUBLE AS confidence FROM m WHERE n <> ''""")
def chapter_mark_list(spark, sf_dir):
    marks = x.chapter_marks(_headed_pages(spark, sf_dir))
    return marks.select("work", "page", "number", F.substring("title", 1, 30).alias("title"), F.round("confidence", 2).alias("confidence"))


@query(_MARKS_SQL + """ SELECT work, page, CAST(n AS INTEGER) AS number, substr(trim(title), 1, 30) AS title FROM m WHERE n <> '' AND CAST(n AS INTEGER) > 0 AND n_panels <= 3 QUALIFY row_number() OVER (PARTITION BY work, page ORDER BY way) = 1""")
def title_page_list(spark, sf_dir):
    return x.title_pages(_headed_pages(spark, sf_dir)).select("work", "page", "number", F.substring("title", 1, 30).alias("title"))


@query("""WITH c AS (SELECT doc_id AS work, CAST(doc_id % 5 AS INTEGER) AS page, lower(substr(CASE doc_id % 4 WHEN 0 THEN 'Meanwhile, ' WHEN 1 THEN 'しかし' ELSE '' END || text, 1, 100)) AS head FROM documents WHERE text IS NOT NULL)
SELECT work, page FROM c WHERE page >= 2 AND (contains(head, 'meanwhile') OR contains(head, 'later') OR contains(head, 'the next day') OR contains(head, 'elsewhere') OR contains(head, 'back at') OR contains(head, 'the following morning') OR contains(head, '翌日') OR contains(head, 'しかし') OR contains(head, 'そして') OR contains(head, '数日後'))""")
def transition_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    opened = F.concat(F.when(F.col("doc_id") % 4 == 0, "Meanwhile, ").when(F.col("doc_id") % 4 == 1, "しかし").otherwise(""), F.col("text"))
    return x.opener_marks(d.select(F.col("doc_id").alias("work"), (F.col("doc_id") % 5).cast("int").alias("page"), opened.alias("text"))).select("work", "page")


@query("""WITH b AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '「' || substr(text, 1, 9) || '」' WHEN 1 THEN 'ドンッ' WHEN 2 THEN '!!?' ELSE substr(replace(text, '"', ''), 1, 40) END AS t FROM benchmark WHERE text IS NOT NULL) SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'sfx' WHEN 2 THEN 'sfx' ELSE 'unknown' END AS kind FROM b""")
def text_block_classes(spark, sf_dir):
    n, text = F.col("item_id") % 4, F.col("text")
    shown = F.when(n == 0, F.concat(F.lit("「"), F.substring(text, 1, 9), F.lit("」"))).when(n == 1, "ドンッ").when(n == 2, "!!?").otherwise(F.substring(F.replace(text, F.lit('"')), 1, 40))
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", t.block_class(shown).alias("kind"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 5 > 0 THEN event_id % 400 END AS page, floor(value) / 100.0 AS cf, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2) DESC, event_id) AS rank FROM events)
SELECT user_id, 'Known so far:' || chr(10) || string_agg('[' || upper(event_type) || CASE WHEN page IS NULL THEN '' ELSE ' p' || page END || '] e' || event_id || ': seen cf:' || printf('%.2f', cf), chr(10) ORDER BY rank) AS block FROM r WHERE rank <= 8 GROUP BY 1""")
def memory_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    best = r.top_k(e.withColumn("v", F.round("value", 2)), ["user_id"], [F.desc("v"), F.asc("event_id")], 8)
    line = r.render(F.col("event_type"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 400), F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("seen"), F.floor("value") / 100.0)
    return r.prompt_block(best.withColumn("line", line), ["user_id"], ["rank"], "line", "Known so far:")


_PROMPT_SQL = """WITH t AS (SELECT conv_id, turn, role, text FROM conversations), w AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(concat_ws(chr(10), 'Describe this panel.', 'Text: ' || text, 'Before: ' || p, 'After: ' || n)) AS prompt_md5 FROM w"""


@query(_PROMPT_SQL)
def analysis_prompts(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))
    return rows.select("conv_id", "turn", F.md5(r.prompt("Describe this panel.", {"Text": F.col("text"), "Before": F.col("before"), "After": F.col("after")})).alias("prompt_md5"))


@query("""SELECT conv_id, md5(concat_ws(chr(10), 'Tell this scene.', 'Turns: ' || count(*), 'People: ' || string_agg(DISTINCT role, ', ' ORDER BY role), 'Dialogue: ' || string_agg(CASE WHEN turn < 4 THEN text END, ' / ' ORDER BY turn))) AS prompt_md5 FROM conversations GROUP BY 1""")
def script_prompts(spark, sf_dir):
    talk = F.array_sort(F.collect_list(F.when((F.col("turn") < 4) & F.col("text").isNotNull(), F.struct("turn", "text"))))
    scenes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("people"), F.array_join(F.transform(talk, lambda v: v["text"]), " / ").alias("talk"))
    known = {"Turns": F.col("n").cast("string"), "People": F.nullif("people", F.lit("")), "Dialogue": F.nullif("talk", F.lit(""))}
    return scenes.select("conv_id", F.md5(r.prompt("Tell this scene.", known)).alias("prompt_md5"))


@query(f"""WITH w AS (SELECT l_orderkey AS page, l_linenumber % 3 AS line, CAST(row_number() OVER ({_KEY_W}) AS INTEGER) AS word, 'w' || l_partkey AS text, CAST(l_partkey % 600 AS INTEGER) AS x, CAST(l_suppkey % 400 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS w, CAST(l_discount * 1000 AS INTEGER) - 10 AS conf FROM lineitem)
SELECT page, CAST(line AS INTEGER) AS line, string_agg(text, ' ' ORDER BY word) AS text, min(x) AS x, max(x + w) - min(x) AS width, round(avg(conf) / 100, 3) AS confidence FROM w WHERE conf >= 0 GROUP BY page, line""")
def recognised_lines(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    words = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), (F.col("l_linenumber") % 3).cast("int").alias("line"), F.col("n").alias("word"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_partkey") % 600).cast("int").alias("left"), (F.col("l_suppkey") % 400).cast("int").alias("top"), q.alias("width"), q.alias("height"), (F.round(F.col("l_discount") * 1000).cast("int") - 10).alias("conf"), F.lit(5).alias("level"))
    lines = readers.word_lines(words, ["page"])
    return lines.select("page", "line", "text", F.col("box.x").alias("x"), F.col("box.w").alias("width"), "confidence")


@query(f"""WITH l AS (SELECT l_orderkey AS page, CAST(row_number() OVER ({_KEY_W}) AS INTEGER) AS n, l_partkey FROM lineitem), p AS (SELECT page, n, CASE WHEN n % 3 = 0 THEN n END AS own, CASE WHEN page % 2 = 0 THEN max(n) OVER (PARTITION BY page) + 1 - n END AS given FROM l)
SELECT page, CAST(n AS INTEGER) AS n, CAST(coalesce(given, own, n) AS INTEGER) AS rank FROM p""")
def panel_ranks(spark, sf_dir):
    panel = F.struct(F.col("n").cast("string").alias("id"), F.lit("").alias("image"), F.array(F.lit(0)).alias("bbox"), F.lit(1.0).alias("confidence"), F.when(F.col("n") % 3 == 0, F.col("n")).alias("reading_order"), F.col("n").alias("n"))
    manifest = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(panel), lambda a, b: a["n"] - b["n"]).alias("panels"))
    order = manifest.where("page % 2 = 0").select("page", F.reverse(F.transform("panels", lambda p: p["id"])).alias("order"))
    return readers.ordered_panels(manifest, order).select("page", F.col("panel_id").cast("int").alias("n"), "rank")


@query("SELECT o_orderkey AS page, 'a' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 1")
def first_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    return readers.first_source([o.where("page % 3 = 0").withColumn("origin", F.lit("a")), o.where("page % 5 <> 1").withColumn("origin", F.lit("b"))], ["page"])


@query("SELECT event_type, coalesce(max(abs(round(value, 2) - 50)), 0.9) AS peak, CAST(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_loud FROM events GROUP BY 1")
def narration_peaks(spark, sf_dir):
    v = F.round("value", 2)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(shots.peak(v - 50).alias("peak"), F.count_if(F.col("value") > 90).alias("n_loud"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w - l_quantity AS s, l_quantity AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, round(s + least(d * 0.25, 2.0), 3) AS at FROM e""")
def event_starts(spark, sf_dir):
    from ..operators.sequence import timeline

    segs = timeline(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity")
    return segs.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("start_time") + F.least(F.col("l_quantity") * 0.25, F.lit(2.0)), 3).alias("at"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE '{"v": ' || event_id || '}' END AS body, 'line ' || event_id AS cleaned FROM events""")
def answer_parts(spark, sf_dir):
    i = F.col("event_id").cast("string")
    prose = F.when(F.col("event_id") % 7 == 0, F.lit("no object {here")).otherwise(F.concat(F.lit("Sure: "), F.lit('{"v": '), i, F.lit("} as asked")))
    fenced = F.concat(F.lit("```text\nNarration: \"line "), i, F.lit("\"\n```"))
    return table(spark, sf_dir, "events").select("event_id", t.json_object(prose).alias("body"), t.strip_answer(fenced).alias("cleaned"))


@query("""SELECT p_partkey, least(1.0, sqrt(2500000.0 / ((p_size + 1) * 100 * (p_size + 2) * 100)))::DOUBLE AS scale, CAST(p_size + 1 AS INTEGER) AS width, CAST(p_size + 2 AS INTEGER) AS height, CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'scan' END AS kind FROM part""")
def page_scales(spark, sf_dir):
    size = F.concat((F.col("p_size") + 1).cast("string"), F.lit("x"), (F.col("p_size") + 2).cast("string"))
    rows = table(spark, sf_dir, "part").withColumn("res", g.resolution(size))
    w, h = F.col("res.w"), F.col("res.h")
    return rows.select("p_partkey", g.clamped_scale(w * 100, h * 100, 2_500_000).alias("scale"), w.alias("width"), h.alias("height"), F.when(F.col("p_size") % 2 == 0, "text").otherwise("scan").alias("kind"))


@query("SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (WHERE l_quantity > 30 OR l_discount > 0.08) AS n_bad, count(*) FILTER (WHERE l_quantity > 30 AND l_discount > 0.08) AS n_both FROM lineitem GROUP BY 1")
def split_by_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    good, bad = rules.split_valid(rows, {"quantity": F.col("l_quantity") <= 30, "discount": F.col("l_discount") <= 0.08})
    both = good.withColumn("errors", F.array().cast("array<string>")).unionByName(bad)
    return both.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.count_if(F.size("errors") > 0).alias("n_bad"), F.count_if(F.size("errors") > 1).alias("n_both"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part), d AS (SELECT p_partkey, list_distinct(list_transform(a, lambda v: lower(v))) AS a, list_distinct(list_transform(b, lambda v: lower(v))) AS b FROM p)
SELECT p_partkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a) AS coverage, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS n_all FROM d""")
def token_coverage(spark, sf_dir):
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in ("p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", s.coverage(a, b).alias("coverage"), F.size(F.array_union(a, b)).alias("n_all"))
