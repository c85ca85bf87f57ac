"""Queries that ingest pages and references into a store, and what users look at."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import short_id
from ..operators import ingest as g
from ..operators import views as v
from ..operators.store import Store, listed
from ..schema import VISUAL
from ..sources import readers
from ..tables import new_path
from .registry import query, table

_PANELS_SQL = """p AS (SELECT 'w' || conv_id % 7 AS work_id, CAST(conv_id % 40 AS INTEGER) AS page, role AS name, CASE WHEN turn % 3 > 0 THEN trim(substr(text, 1, 120)) END AS description, CASE WHEN turn % 4 = 0 THEN ' unknown ' ELSE 'Place ' || turn % 3 END AS place, CASE WHEN turn % 5 = 0 THEN '' ELSE 'event ' || turn END AS event FROM conversations)"""


def _panels(spark, sf_dir):
    """Turns as panels: who speaks is seen, somewhere, and something happens."""
    t, c = F.col("turn"), F.col("conv_id")
    person = F.struct(F.col("role").alias("name"), F.when(t % 3 > 0, F.col("text")).alias("description"), F.lit("").alias("action"), F.lit("").alias("emotion"))
    none = F.array().cast("array<string>")
    visual = F.struct(F.array(person).alias("characters"), F.when(t % 4 == 0, " unknown ").otherwise(F.concat(F.lit("Place "), (t % 3).cast("string"))).alias("environment"), none.alias("actions"), none.alias("objects"), none.alias("visual_effects"), F.when(t % 5 == 0, "").otherwise(F.concat(F.lit("event "), t.cast("string"))).alias("important_event"), F.lit("").alias("composition"), F.lit("").alias("story_relevance"), F.lit(0.5).alias("confidence"))
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("w"), (c % 7).cast("string")).alias("work_id"), (c % 40).cast("int").alias("page"), visual.cast(VISUAL).alias("visual"))


def _ingested(spark, sf_dir):
    store = Store(spark, new_path(spark, "ingest"))
    g.ingest_pages(store, _panels(spark, sf_dir))
    return store


@query(f"""WITH {_PANELS_SQL} SELECT work_id, 'char_' || substr(md5(work_id || ':' || lower(name)), 1, 8) AS character_id, max(name) AS name, arg_max(description, (page, description)) FILTER (WHERE description <> '') AS description, min(page) AS first_page, max(page) AS last_page, CAST(count(*) AS INTEGER) AS appearance_count FROM p GROUP BY work_id, lower(name)""")
def ingested_characters(spark, sf_dir):
    return _ingested(spark, sf_dir).table("characters").select("work_id", short_id(F.col("character_id")).alias("character_id"), "name", "description", "first_page", "last_page", "appearance_count")


@query(f"""WITH {_PANELS_SQL} SELECT 'characters' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT work_id, name FROM p) UNION ALL SELECT 'source_evidence', count(*) FROM p UNION ALL SELECT 'locations', count(*) FROM (SELECT DISTINCT work_id, place FROM p WHERE place <> ' unknown ')
UNION ALL SELECT 'events', count(*) FROM (SELECT DISTINCT work_id, page, event FROM p WHERE event <> '') UNION ALL SELECT 'processing_checkpoints', count(*) FROM (SELECT DISTINCT work_id, page FROM p)""")
def ingested_tables(spark, sf_dir):
    return _ingested(spark, sf_dir).stats().where("n_rows > 0")


_BOOKS_SQL = "b AS (SELECT 'w' || s_suppkey AS work_id, CASE WHEN s_suppkey % 9 > 0 THEN s_name ELSE ' ' END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'author ' || s_nationkey END AS author, CASE WHEN s_suppkey % 3 = 0 THEN ['action', 'g' || s_nationkey] END AS genres, CASE WHEN s_acctbal > 0 THEN 'ongoing' ELSE '' END AS status FROM supplier)"


def _books(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("w"), k.cast("string")).alias("work_id"), F.when(k % 9 > 0, F.col("s_name")).otherwise(" ").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("author "), n)).alias("author"), F.when(k % 3 == 0, F.array(F.lit("action"), F.concat(F.lit("g"), n))).alias("genres"), F.when(F.col("s_acctbal") > 0, "ongoing").otherwise("").alias("status"), F.lit(None).cast("string").alias("synopsis"))


@query(f"""WITH {_BOOKS_SQL}, u AS (SELECT work_id, unnest([{{'k': 'title', 'v': title}}, {{'k': 'author', 'v': author}}, {{'k': 'genres', 'v': array_to_string(genres, ', ')}}, {{'k': 'status', 'v': status}}]) AS e FROM b WHERE trim(title) <> '')
SELECT u.work_id, e.k AS entity_key, e.v AS value, w.title, 0.8::DOUBLE AS confidence FROM u JOIN b w ON w.work_id = u.work_id WHERE e.v <> ''""")
def stored_references(spark, sf_dir):
    store = Store(spark, new_path(spark, "references"))
    g.store_references(store, _books(spark, sf_dir))
    return store.table("source_evidence").join(store.table("works").select("work_id", "title"), "work_id").select("work_id", "entity_key", "value", "title", "confidence")


@query("""WITH c AS (SELECT 'w' || c_nationkey AS work_id, CASE WHEN c_custkey % 8 > 0 THEN c_name ELSE '  ' END AS name, c_mktsegment AS role FROM customer)
SELECT work_id, 'char_' || substr(md5(work_id || ':' || lower(name)), 1, 8) AS character_id, name, role, 0.7::DOUBLE AS confidence, 'Name: ' || name || ', Role: ' || role AS told FROM c WHERE trim(name) <> ''""")
def stored_casts(spark, sf_dir):
    store = Store(spark, new_path(spark, "casts"))
    c = F.col("c_custkey")
    g.store_cast(store, table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("work_id"), F.when(c % 8 > 0, F.col("c_name")).otherwise("  ").alias("name"), F.col("c_mktsegment").alias("role"), F.lit(None).cast("string").alias("description")))
    told = store.table("source_evidence").select("work_id", F.col("entity_key").alias("character_id"), F.col("value").alias("told"))
    return store.table("characters").join(told, ["work_id", "character_id"]).select("work_id", short_id(F.col("character_id")).alias("character_id"), "name", "role", "confidence", "told")


@query("""WITH l AS (SELECT user_id % 30 AS project, event_id, CASE WHEN event_id % 3 > 0 THEN 'page p.' || event_id % 5 % 4 || ': ' ELSE '' END AS head, event_id % 5 % 4 AS page, CASE WHEN event_id % 7 = 0 THEN ' N/A ' ELSE event_type || ' ' || event_id % 23 END AS fact FROM events),
t AS (SELECT project, event_id, CASE WHEN event_id % 3 > 0 AND page > 0 THEN head ELSE '' END || fact AS line FROM l WHERE fact <> ' N/A '),
f AS (SELECT project, list_reduce(list([line] ORDER BY event_id), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x)[-40:] END) AS facts FROM t GROUP BY 1)
SELECT project, len(facts) AS n, array_to_string(facts, '; ') AS facts FROM f""")
def remembered_fact_lines(spark, sf_dir):
    i = F.col("event_id")
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("project"), "event_id", F.when(i % 3 > 0, i % 5 % 4).alias("page"), F.when(i % 7 == 0, " N/A ").otherwise(F.concat_ws(" ", "event_type", (i % 23).cast("string"))).alias("fact"))
    return g.remembered_facts(log, "project", "event_id").select("project", F.size("facts").cast("long").alias("n"), F.array_join("facts", "; ").alias("facts"))


_KIND_SQL = "CASE event_type WHEN 'view' THEN 'world' WHEN 'click' THEN 'story' WHEN 'error' THEN 'correction' WHEN 'signup' THEN 'book' ELSE 'character' END"


@query(f"""SELECT {_KIND_SQL} AS kind, coalesce(CASE WHEN event_id % 4 > 0 THEN list_element(['place', 'object', 'thread'], CAST(event_id % 3 + 1 AS INTEGER)) END, 'none') AS type, count(*) AS n FROM events WHERE event_type <> 'purchase' OR event_id % 2 = 0 GROUP BY ALL""")
def memory_kinds(spark, sf_dir):
    """Events as records under other names of kinds; each kind's records of each type."""
    i = F.col("event_id")
    names = F.create_map(*(F.lit(x) for kv in {"view": "Places", "click": "event", "error": "user", "signup": "book", "purchase": "whatever"}.items() for x in kv))
    of = F.when(i % 4 > 0, F.element_at(F.array(F.lit("place"), F.lit("object"), F.lit("thread")), (i % 3 + 1).cast("int")))
    records = table(spark, sf_dir, "events").where("event_type <> 'purchase' OR event_id % 2 = 0").select(F.try_element_at(names, "event_type").alias("kind"), F.when(of.isNotNull(), F.create_map(F.lit("type"), of)).otherwise(F.create_map().cast("map<string,string>")).alias("value"))
    parts = [v.typed(records, k, t).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.lit(t).alias("type"), "n") for k in v.OWN_KINDS for t in ("place", "object", "thread")]
    parts += [v.typed(records, k).where(F.try_element_at("value", F.lit("type")).isNull()).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.lit("none").alias("type"), "n") for k in v.OWN_KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS d, list_element(['cut', 'fade', 'dissolve', 'wipe'], CAST(l_partkey % 4 + 1 AS INTEGER)) AS k, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
t AS (SELECT *, CASE WHEN k = 'wipe' THEN 'cut' ELSE k END AS type, CASE WHEN n IS NULL THEN 0.0 ELSE least(0.3, 0.5 * least(d, n)) END AS l FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, type, CASE WHEN type = 'cut' THEN 0 ELSE l END::DOUBLE AS length, CASE WHEN type = 'dissolve' THEN l ELSE 0 END::DOUBLE AS overlap FROM t""")
def typed_transition_list(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("cut", "fade", "dissolve", "wipe"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    shots = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("d"), kind.alias("k"))
    return v.typed_transitions(shots, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "d", "k").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "type", "length", "overlap")


@query("""WITH s AS (SELECT o_orderkey AS shot_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'p' || o_custkey END AS pp, CASE WHEN o_orderkey % 9 > 0 THEN 'p' || o_custkey % 50 END AS fp FROM orders),
p AS (SELECT 'p' || c_custkey AS panel_id, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS image, c_nationkey AS width, c_custkey % 11 AS height FROM customer WHERE c_custkey % 13 > 0),
j AS (SELECT shot_id, coalesce(nullif(pp, ''), fp) AS panel_id FROM s)
SELECT shot_id, j.panel_id, image, width, height, CASE WHEN p.panel_id IS NULL THEN 'no panel' WHEN image = '' THEN 'no image' WHEN width <= 0 OR height <= 0 THEN 'no size' END AS error FROM j LEFT JOIN p ON p.panel_id = j.panel_id""")
def shot_motion_sources(spark, sf_dir):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    shots = table(spark, sf_dir, "orders").select(o.alias("shot_id"), F.when(o % 3 == 0, "").otherwise(name(k)).alias("primary_panel"), F.when(o % 9 > 0, F.array(name(k % 50), F.lit("px"))).alias("panel_ids"))
    c = F.col("c_custkey")
    panels = table(spark, sf_dir, "customer").where(c % 13 > 0).select(name(c).alias("panel_id"), F.when(c % 5 > 0, F.col("c_name")).otherwise("").alias("image"), F.col("c_nationkey").alias("width"), (c % 11).alias("height"))
    return v.shot_sources(shots, panels)


@query(f"""WITH n AS (SELECT {_KIND_SQL} AS kind FROM events) SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 's' || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey % 3 > 0 THEN '/images/s' || s_suppkey || '/cover' || s_nationkey || '.jpg' END AS cover_url,
(SELECT count(*) FROM n WHERE kind = 'character') AS n_character, (SELECT count(*) FROM n WHERE kind = 'world') AS n_world, (SELECT count(*) FROM n WHERE kind = 'story') AS n_story, (SELECT count(*) FROM n WHERE kind = 'correction') AS n_correction, (SELECT count(*) FROM n WHERE kind = 'book') AS n_book FROM supplier""")
def project_list(spark, sf_dir):
    k = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier").withColumns({"slug": F.concat(F.lit("s"), k.cast("string")), "cover_file": F.concat(F.lit("cover"), F.col("s_nationkey").cast("string"), F.lit(".jpg"))})
    names = F.create_map(*(F.lit(x) for kv in {"view": "places", "click": "event", "error": "user", "signup": "book", "purchase": "char"}.items() for x in kv))
    records = table(spark, sf_dir, "events").select(F.try_element_at(names, "event_type").alias("kind"))
    projects = supplier.select("slug", F.when(k % 4 == 0, "").otherwise(F.col("s_name")).alias("name"), "cover_file")
    return v.projects_with_counts(projects, supplier.where("s_suppkey % 3 > 0").select("slug", F.col("cover_file").alias("file")), records)


@query("""WITH e AS (SELECT l_orderkey AS work, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position, 'a' || l_partkey AS own, l_partkey % 3 = 0 AS has_own FROM lineitem),
u AS (SELECT DISTINCT work, position FROM e WHERE position % 2 = 0), f AS (SELECT DISTINCT work, own FROM e WHERE has_own)
SELECT e.work, e.position, CASE WHEN f.own IS NOT NULL THEN e.own || '.wav' ELSE 'segment_' || lpad(CAST(e.position + 1 AS VARCHAR), 3, '0') || '.wav' END AS file FROM e LEFT JOIN f ON f.work = e.work AND f.own = e.own LEFT JOIN u ON u.work = e.work AND u.position = e.position WHERE f.own IS NOT NULL OR u.position IS NOT NULL""")
def segment_audio_files(spark, sf_dir):
    lines = listed(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    own = F.concat(F.lit("a"), F.col("l_partkey").cast("string"), F.lit(".wav"))
    entries = lines.select(F.col("l_orderkey").alias("work"), (F.col("position") - 1).alias("position"), F.concat(F.lit("/out/"), own).alias("audio_path"), own.alias("own"), (F.col("l_partkey") % 3 == 0).alias("has_own"))
    files = entries.where("has_own").select("work", F.col("own").alias("file")).unionByName(entries.where("position % 2 = 0").select("work", F.format_string("segment_%03d.wav", F.col("position") + 1).alias("file")))
    return v.segment_audio(entries, files)


@query("""SELECT o_orderkey AS page, count(l_orderkey) AS n_panels, count(*) FILTER (WHERE l_returnflag = 'R') AS n_clean FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def page_panel_counts(spark, sf_dir):
    panels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_returnflag") == "R").alias("cleaned"))
    return v.panel_counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")), panels, ["page"])


@query("""SELECT c_custkey, (c_custkey % 5 = 0 OR c_nationkey = 3) AS offline FROM customer""")
def engine_modes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "mock").when(F.col("c_custkey") % 2 == 0, "gemini").alias("vlm"), F.when(F.col("c_nationkey") == 3, "dummy").otherwise("").alias("tts"))
    return v.offline(c, ["c_custkey"], ["vlm", "tts"])


@query("""WITH f AS (SELECT p_size AS album, replace(p_name, ' ', '_') || '.' || list_element(['wav', 'mp3', 'ogg', 'txt'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS file, list_element([1, 2, 4], CAST(p_partkey % 4 + 1 AS INTEGER)) AS rank FROM part WHERE p_size % 7 > 0),
q AS (SELECT DISTINCT p_size AS album, CASE WHEN p_size % 3 = 0 THEN 'red_ring.wav' END AS wanted FROM part), b AS (SELECT album, arg_min(file, (rank, file)) FILTER (WHERE rank IS NOT NULL) AS first FROM f GROUP BY 1)
SELECT q.album, wanted, CASE WHEN wanted IS NULL THEN first WHEN EXISTS (SELECT 1 FROM f WHERE f.album = q.album AND f.file = wanted) THEN wanted END AS track,
CASE WHEN wanted IS NULL THEN CASE WHEN first IS NULL THEN 'no music files' END WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.album = q.album AND f.file = wanted) THEN 'not found' END AS error FROM q LEFT JOIN b ON b.album = q.album""")
def music_tracks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ending = F.element_at(F.array(*map(F.lit, ("wav", "mp3", "ogg", "txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = part.where("p_size % 7 > 0").select(F.col("p_size").alias("album"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), ending).alias("file"))
    asked = part.select(F.col("p_size").alias("album")).distinct().withColumn("wanted", F.when(F.col("album") % 3 == 0, "red_ring.wav"))
    return v.music_track(files, asked, ["album"])


@query("""WITH l AS (SELECT doc_id % 50 AS book, doc_id // 50 AS page, unnest(string_split(replace(text, '. ', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', chr(10)), chr(10)), 1) AS pos FROM documents WHERE doc_id // 50 < 6),
t AS (SELECT book, page, pos, trim(line, ' ') AS line FROM l WHERE length(trim(line, ' ')) >= 3), o AS (SELECT book, line, min((page, pos)) AS f FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY book, f[1] ORDER BY f) AS r FROM o), k AS (SELECT book, line, f FROM n WHERE r <= 40),
w AS (SELECT book, line, row_number() OVER (PARTITION BY book ORDER BY f) AS place, coalesce(sum(length(line)) OVER (PARTITION BY book ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT book, CAST(place AS INTEGER) AS place, line FROM w WHERE before <= 2000""".replace("min((page, pos)) AS f", "min([page, pos]) AS f"))
def text_probes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("book"), F.floor(F.col("doc_id") / 50).alias("page"), F.replace("text", F.lit(". "), F.lit("\n")).alias("text"))
    return v.text_probe(d, ["book"], "page", "text")


@query("""WITH ch AS (SELECT user_id % 10 AS work, event_id % 9 AS chapter, event_id AS seq, event_type || ' ' || event_id AS description, event_id % 11 / 10.0::DOUBLE AS importance, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS person FROM events WHERE event_id % 9 < 7 AND event_id % 40 = 0),
c AS (SELECT w.range AS work, k.range AS chapter, CAST(k.range * 10 AS INTEGER) AS a, CAST(k.range * 10 + 9 AS INTEGER) AS b FROM range(10) w, range(9) k),
t AS (SELECT work, chapter, count(*) AS n, list(description ORDER BY seq) AS ds, list(description ORDER BY seq) FILTER (WHERE importance >= 0.6) AS lead, coalesce(list(description ORDER BY seq) FILTER (WHERE importance >= 0.5), []) AS imp, string_agg(concat_ws(' · ', person, description), chr(10) ORDER BY seq) AS medium FROM ch WHERE importance >= 0.3 GROUP BY ALL),
p AS (SELECT s_nationkey % 10 AS work, s_name AS name, CAST(s_suppkey % 90 AS INTEGER) AS page FROM supplier WHERE s_suppkey % 6 > 0), n AS (SELECT c.work, c.chapter, string_agg(DISTINCT name, '|' ORDER BY name) AS new FROM c JOIN p ON p.work = c.work AND page BETWEEN a AND b GROUP BY ALL)
SELECT c.work, c.chapter, CASE WHEN t.n IS NULL THEN 'Chapter ' || c.chapter || ': (no significant events detected)' ELSE 'Chapter ' || c.chapter || ' covers ' || t.n || ' key moments. ' || array_to_string((CASE WHEN len(lead) > 0 THEN lead ELSE ds END)[1:3], ' ') END AS short, coalesce(medium, '') AS medium, coalesce(t.n, 0) AS n_events, coalesce(array_to_string(imp, '|'), '') AS important, coalesce(new, '') AS new_characters FROM c LEFT JOIN t ON t.work = c.work AND t.chapter = c.chapter LEFT JOIN n ON n.work = c.work AND n.chapter = c.chapter""")
def chapter_summary_texts(spark, sf_dir):
    i = F.col("event_id")
    works = spark.range(10).select(F.col("id").alias("work"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("chapter"))
    chapters = works.withColumns({"start_page": (F.col("chapter") * 10).cast("int"), "end_page": (F.col("chapter") * 10 + 9).cast("int")})
    events = table(spark, sf_dir, "events").where((i % 9 < 7) & (i % 40 == 0)).select((F.col("user_id") % 10).alias("work"), (i % 9).alias("chapter"), i.alias("seq"), F.concat_ws(" ", "event_type", i.cast("string")).alias("description"), (i % 11 / F.lit(10.0)).alias("importance"), F.when(i % 2 == 0, F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")))).alias("people"))
    people = table(spark, sf_dir, "supplier").where("s_suppkey % 6 > 0").select((F.col("s_nationkey") % 10).alias("work"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 90).cast("int").alias("first_page"))
    return v.chapter_summaries(chapters, events, people, ["work"])


@query("""SELECT l_orderkey, max(l_quantity) + 0.5 AS seconds FROM lineitem GROUP BY 1""")
def mix_lengths(spark, sf_dir):
    return v.total_duration(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


@query("""SELECT CAST(o_orderkey % 30 AS INTEGER) AS page, count(*) AS n_segments, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 + 4 ELSE o_orderkey % 50 + o_orderkey % 7 END), 2)::DOUBLE AS ends, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS n_speakers FROM orders WHERE o_orderkey % 30 <> 7 GROUP BY 1""")
def artifact_scripts(spark, sf_dir):
    """Scripts of pages are written as JSON files, one of them broken, and read back under their schema; an end that is not given
    is the start and the duration."""
    o = F.col("o_orderkey")
    segment = F.struct(o.alias("id"), (o % 50).cast("double").alias("start"), F.when(o % 3 == 0, (o % 50 + 4).cast("double")).alias("end"), (o % 7).cast("double").alias("duration"), F.when(o % 4 == 0, "someone").alias("speaker"))
    docs = table(spark, sf_dir, "orders").select((o % 30).cast("int").alias("page"), segment.alias("s")).groupBy("page").agg(F.collect_list("s").alias("segments"))
    text = F.when(F.col("page") == 7, "{\"page\": 7, \"segments\": [").otherwise(F.to_json(F.struct("page", "segments")))
    path = new_path(spark, "scripts")
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    good, bad = readers.artifacts(spark, path, "page INT, segments ARRAY<STRUCT<id: LONG, start: DOUBLE, end: DOUBLE, duration: DOUBLE, speaker: STRING>>")
    rows = good.where("page IS NOT NULL").select("page", F.explode("segments").alias("s"))
    end = readers.one_of(F.col("s.end"), F.col("s.start") + F.col("s.duration"))
    return rows.groupBy("page").agg(F.count("*").alias("n_segments"), F.round(F.sum(end), 2).alias("ends"), F.count("s.speaker").alias("n_speakers"))
