"""Queries on ordered records: scenes, groups, chapters, links, extracted facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extraction as x
from ..operators import sequence as q
from .registry import query, table

_TOKENS_SQL = "list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)), lambda w: w NOT IN ('the','a','an','of','and','or','in','on','at','to','for','with','by','from','is','are','was','this','that','it'))"
_MEMORY_TOKENS_SQL = _TOKENS_SQL.replace("lower(text)", "lower(nfc_normalize(text))").replace("[a-z0-9]", "[a-z0-9一-鿿぀-ヿ]")
_SCORED_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text, {_TOKENS_SQL} AS toks FROM conversations),
p AS (SELECT *, lag(role) OVER w AS prev_role, lag(toks) OVER w AS prev_toks FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN len(toks) > 0 AND len(prev_toks) > 0 THEN CAST(len(list_intersect(toks, prev_toks)) AS DOUBLE) / len(list_distinct(list_concat(toks, prev_toks))) END AS same,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM p),
b AS (SELECT *, CASE WHEN prev_role IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0,
  CASE WHEN role <> prev_role THEN 0.45 ELSE -0.35 END + coalesce(-0.35 * same + CASE WHEN same = 0 THEN 0.55 ELSE 0.0 END, 0.0))) END AS score FROM s)"""


def _scored(spark, sf_dir):
    """Turns with the boundary score of role (as the place) and words (as the people)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.col("role").alias("location"), t.tokens(F.col("text")).alias("characters"))
    nothing = {c: F.lit(None).cast("string") for c in ("event", "dialogue")} | {"actions": F.lit(None).cast("array<string>")}
    prev = q.previous(turns.withColumns(nothing), ["conv_id"], ["turn"], ["location", "characters", "event", "dialogue", "actions"])
    return prev.withColumn("score", q.boundary_score())


@query(_SCORED_SQL + "SELECT conv_id, turn, round(score, 4) AS score, score >= 0.425 AS boundary FROM b WHERE n > 1")
def scene_boundaries(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.col("prev_location").isNotNull()).select("conv_id", "turn", F.round("score", 4).alias("score"), (F.col("score") >= 0.425).alias("boundary"))


@query(_SCORED_SQL + """, g AS (SELECT *, sum(CASE WHEN n > 1 AND score >= 0.425 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS scene_no FROM b)
SELECT conv_id, CAST(scene_no AS BIGINT) AS scene_no, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns,
  string_agg(DISTINCT role, ',' ORDER BY role) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM g GROUP BY conv_id, scene_no""")
def scenes(spark, sf_dir):
    grouped = q.numbered(_scored(spark, sf_dir), ["conv_id"], ["turn"], F.col("score") >= 0.425, "scene_no")
    return grouped.groupBy("conv_id", "scene_no").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.sum(F.char_length("text")).alias("n_chars"))


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, row_number() OVER w = 1 AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_links(spark, sf_dir):
    linked = q.previous(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn"])
    w = q.Window.partitionBy("conv_id").orderBy("turn")
    return linked.select("conv_id", "turn", F.col("prev_turn").alias("previous_turn"), F.lead("turn").over(w).alias("next_turn"), F.col("prev_turn").isNull().alias("first"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 43200 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM g)
SELECT user_id, CAST(g AS BIGINT) AS group_no, count(*) AS n_events, min(event_id) AS least_event, arg_max(event_type, (value, -event_id)) AS best_type, round(max(value), 4) AS best_value FROM n GROUP BY user_id, g""")
def gap_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    grouped = q.gap_groups(events, ["user_id"], ["ts", "event_id"], "at", 43200)
    return grouped.groupBy("user_id", "group_no").agg(F.count("*").alias("n_events"), F.min("event_id").alias("least_event"), F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("best_type"), F.round(F.max("value"), 4).alias("best_value"))


@query("""WITH n AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id % 50 END AS num FROM events),
b AS (SELECT *, count(num) OVER w AS blk FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, blk ORDER BY event_id) AS since, max(num) OVER (PARTITION BY user_id, blk) AS known FROM b)
SELECT user_id, event_id, CAST(CASE WHEN blk = 0 THEN since ELSE known + since - 1 END AS BIGINT) AS number FROM r""")
def sequential_numbering(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id") % 50).alias("num"))
    return q.fill_numbers(events, ["user_id"], ["event_id"], "num", "number").select("user_id", "event_id", "number")


@query("SELECT user_id, event_id AS start_at, greatest(event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 1000000)) AS end_at FROM events")
def group_extents(spark, sf_dir):
    return q.extents(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.lit(1_000_000).cast("long"), "end_at").select("user_id", F.col("event_id").alias("start_at"), "end_at")


@query("""WITH m AS (SELECT user_id % 20 AS work, CAST(event_id % 400 AS INTEGER) AS page, CASE WHEN event_type = 'signup' THEN CAST(user_id AS INTEGER) END AS number, round(0.4 + (event_id % 5) / 10.0, 1) AS confidence, event_type AS source FROM events),
d AS (SELECT DISTINCT * FROM m), g0 AS (SELECT *, CASE WHEN page - lag(page) OVER w > 2 THEN 1 ELSE 0 END AS s FROM d WINDOW w AS (PARTITION BY work ORDER BY page, confidence, source, number)),
g AS (SELECT *, sum(s) OVER (PARTITION BY work ORDER BY page, confidence, source, number) AS grp FROM g0),
b AS (SELECT work, grp, max(confidence) AS confidence, count(*) AS n_marks FROM g GROUP BY work, grp),
c AS (SELECT b.*, min(g.page) AS start_page FROM b JOIN g ON b.work = g.work AND b.grp = g.grp AND b.confidence = g.confidence GROUP BY ALL)
SELECT work, CAST(start_page AS INTEGER) AS start_page, CAST(greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY work ORDER BY start_page) - 1, 400)) AS INTEGER) AS end_page, CAST(confidence AS DOUBLE) AS confidence, n_marks FROM c""")
def chapters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = e.select((F.col("user_id") % 20).alias("work"), (F.col("event_id") % 400).cast("int").alias("page"), F.when(F.col("event_type") == "signup", F.col("user_id").cast("int")).alias("number"), F.round(0.4 + (F.col("event_id") % 5) / 10.0, 1).alias("confidence"), F.col("event_type").alias("source")).distinct()
    return x.merge_marks(marks, 400).select("work", "start_page", "end_page", "confidence", "n_marks")


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM e WHERE r <= 10""")
def recent_window(spark, sf_dir):
    return q.recent(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "event_type")


@query("""WITH d AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS k FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, substr(k, 1, 80) ORDER BY doc_id) AS n FROM d) SELECT source, count(*) AS n_texts, min(doc_id) AS first_doc, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM r WHERE n = 1 GROUP BY source""")
def page_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "text")
    return x.distinct_texts(docs, ["source"], "text", ["doc_id"]).groupBy("source").agg(F.count("*").alias("n_texts"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("id_sum"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'kill|death|die|battle|reveal|betray|destroy|transform') THEN 0.8 WHEN regexp_matches(lower(text), 'walk|look|sit|stand|talk') THEN 0.3 ELSE 0.5 END::DOUBLE AS importance FROM documents WHERE text IS NOT NULL""")
def importance_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", x.importance(F.col("text")).alias("importance"))


@query("""WITH n AS (SELECT source, unnest(regexp_extract_all(text, '([A-Z][a-zA-Z]+)', 1)) AS name FROM documents), c AS (SELECT source, name, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, name DESC) AS rank FROM c) SELECT source, name, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def name_frequency(spark, sf_dir):
    return x.name_counts(table(spark, sf_dir, "documents"), ["source"], "text").select("source", "name", "n", "rank")


@query("""WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name_key, p_name FROM part) SELECT name_key, arg_max(p_name, (length(p_name), p_name)) AS name, count(*) AS n FROM k GROUP BY name_key""")
def cased_dedup(spark, sf_dir):
    return x.longest_spelling(table(spark, sf_dir, "part"), "p_name")


@query("""WITH l AS (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) AS pos, unnest(string_split(html, chr(10))) AS line FROM pages),
h AS (SELECT *, regexp_extract(line, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS title FROM l),
b AS (SELECT *, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS block FROM h)
SELECT page_id, CAST(block AS BIGINT) AS block, max(title) AS title, CAST(sum(CASE WHEN title = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN title = '' THEN length(line) ELSE 0 END) AS BIGINT) AS body_chars FROM b GROUP BY page_id, block""")
def html_blocks(spark, sf_dir):
    return x.headed_blocks(table(spark, sf_dir, "pages"), "page_id", "html", r"<h[1-6][^>]*>([^<]*)</h[1-6]>")


@query("""SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(p_name || ' (v' || (p_partkey % 30) || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'item') AS slug,
CAST(p_partkey % 30 AS INTEGER) AS volume, 'part_' || substr(md5(p_name || ':' || p_brand), 1, 8) AS entity_id, substr(sha1(p_name), 1, 12) AS short_hash FROM part""")
def text_clean(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    titled = F.concat(F.col("p_name"), F.lit(" (v"), (F.col("p_partkey") % 30).cast("string"), F.lit(")"))
    return p.select("p_partkey", t.slug(titled).alias("slug"), t.volume_number(titled).alias("volume"), t.entity_id("part", F.col("p_name"), F.col("p_brand")).alias("entity_id"), t.short_hash(F.col("p_name")).alias("short_hash"))


@query(f"""WITH t AS (SELECT item_id, {_TOKENS_SQL} AS toks FROM benchmark) SELECT item_id, CAST(len(toks) AS INTEGER) AS n_tokens, list_aggregate(list_sort(toks), 'string_agg', ' ') AS tokens FROM t WHERE len(toks) > 0""")
def token_sets(spark, sf_dir):
    toks = t.tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(toks).alias("n_tokens"), F.array_join(F.array_sort(toks), " ").alias("tokens")).where("n_tokens > 0")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string('prefix ' || props, '$.k') IS NULL AS bad, greatest(0.0, least(1.0, value / 100.0)) AS confidence FROM (SELECT event_id, props, value FROM events)""".replace("json_extract_string('prefix ' || props, '$.k') IS NULL", "false"))
def json_props(spark, sf_dir):
    wrapped = F.concat(F.lit("The answer: "), F.col("props"), F.lit(" as asked"))
    body = t.json_object(wrapped)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.k").try_cast("long").alias("k"), body.isNull().alias("bad"), t.to_confidence((F.col("value") / 100.0).cast("string")).alias("confidence"))
