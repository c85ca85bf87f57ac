"""Queries on the entity store and the memory records: listings, lookups, logs, deletions, layered context."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as s
from ..functions import text as t
from ..operators import entities as e
from ..operators import jobs
from ..operators import matching as m
from ..operators import retrieval as r
from ..operators import store
from .registry import query, table

_EVENTS_SQL = "SELECT user_id % 20 AS work_id, event_id, CAST(event_id % 400 AS INTEGER) AS page_number, CAST(event_id % 400 // 20 AS INTEGER) AS chapter_id, event_type, floor(value) / 100.0 AS importance FROM events"


def _events(spark, sf_dir):
    """The events table as the store's events: a work is a twentieth of the users."""
    page = (F.col("event_id") % 400).cast("int")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("work_id"), "event_id", page.alias("page_number"), F.floor(page / 20).cast("int").alias("chapter_id"), "event_type", (F.floor("value") / 100.0).alias("importance"))


@query(f"""WITH e AS ({_EVENTS_SQL}) SELECT work_id, event_id, page_number, importance, row_number() OVER (PARTITION BY work_id ORDER BY page_number, event_id) AS position FROM e WHERE chapter_id BETWEEN 2 AND 9 AND event_type <> 'view' AND importance >= 0.3""")
def store_events(spark, sf_dir):
    wanted = F.col("chapter_id").between(2, 9) & (F.col("event_type") != "view") & (F.col("importance") >= 0.3)
    return store.listed(_events(spark, sf_dir), ["work_id"], ["page_number", "event_id"], wanted).select("work_id", "event_id", "page_number", "importance", "position")


@query("SELECT source AS work_id, doc_id AS summary_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 100, doc_id) AS position FROM documents WHERE lang = 'en' AND doc_id % 3 <> 0")
def store_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), F.col("doc_id").alias("summary_id"), "lang", (F.col("doc_id") % 100).alias("page_number"))
    return store.listed(rows, ["work_id"], ["page_number", "summary_id"], (F.col("lang") == "en") & (F.col("summary_id") % 3 != 0)).select("work_id", "summary_id", "position")


@query("""WITH l AS (SELECT l_suppkey % 50 AS a, l_partkey % 50 AS b, max(l_discount) AS confidence FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50 GROUP BY l_suppkey % 50, l_partkey % 50),
o AS (SELECT a AS character_id, b AS other, confidence FROM l UNION ALL SELECT b, a, confidence FROM l)
SELECT character_id, other, confidence, row_number() OVER (PARTITION BY character_id ORDER BY confidence DESC, other) AS position FROM (SELECT DISTINCT * FROM o)""")
def relationships_of(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("character_a"), (F.col("l_partkey") % 50).alias("character_b")).agg(F.max("l_discount").alias("confidence")).where("character_a <> character_b")
    return store.listed(store.both_sides(pairs).distinct(), ["character_id"], [F.desc("confidence"), "other"])


@query("""SELECT event_type AS entity_type, user_id AS entity_key, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY round(value, 2) DESC, ts, event_id) AS position FROM events""")
def evidence_of(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_key"), "event_id", F.round("value", 2).alias("confidence"), "ts")
    return store.listed(log, ["entity_type", "entity_key"], [F.desc("confidence"), "ts", "event_id"]).select("entity_type", "entity_key", "event_id", "position")


@query("""SELECT o_custkey AS entity_key, o_orderkey AS conflict_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'""")
def unresolved_conflicts(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_key"), F.col("o_orderkey").alias("conflict_id"), "o_orderdate", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("resolution"))
    return store.listed(log, ["entity_key"], [F.desc("o_orderdate"), "conflict_id"], F.col("resolution") == "").select("entity_key", "conflict_id", "position")


@query("""WITH a AS (SELECT DISTINCT user_id AS id FROM events UNION SELECT DISTINCT user_id + 1000000 FROM events), g AS (SELECT c_custkey AS id, c_name AS name, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug FROM customer)
SELECT a.id, g.name, coalesce(g.slug, 'item') AS slug, CASE WHEN g.id IS NULL THEN 'pending' ELSE 'completed' END AS status FROM a LEFT JOIN g ON a.id = g.id""")
def point_lookups(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    asked = users.union(users.select(F.col("id") + 1_000_000))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), t.slug(F.col("c_name")).alias("slug"), F.lit("completed").alias("status"))
    return store.looked_up_rows(asked, known, ["id"], {"slug": "item", "status": "pending"})


@query("""WITH l AS (SELECT user_id AS work_id, CAST(event_id % 5 AS INTEGER) AS stage, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events)
SELECT work_id, stage, arg_max(status, seq) AS status, max(ts) FILTER (WHERE status = 'running') AS started_at, max(ts) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at, count(*) AS n FROM l GROUP BY ALL""")
def checkpoint_table(spark, sf_dir):
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), (F.col("event_id") % 5).cast("int").alias("stage"), F.col("event_id").alias("seq"), "ts", F.when(kind.isin("view", "click"), "running").when(kind == "purchase", "completed").otherwise("failed").alias("status"))
    return store.checkpoints(log, ["work_id", "stage"], "seq", "ts")


@query("""WITH c AS (SELECT user_id % 50 AS work_id, event_type AS query, 'r' || arg_max(event_id, ts) AS result, max(ts) AS at FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events),
a AS (SELECT DISTINCT user_id % 60 AS work_id, event_type AS query FROM events) SELECT a.work_id, a.query, CASE WHEN epoch(n.now) - epoch(c.at) <= 86400 * 20 THEN c.result END AS result FROM a CROSS JOIN n LEFT JOIN c ON a.work_id = c.work_id AND a.query = c.query""")
def cached_research(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    now = F.broadcast(ev.agg(F.max("ts").alias("now")))  # one row
    cache = ev.select((F.col("user_id") % 50).alias("work_id"), F.col("event_type").alias("query"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result"), F.col("ts").alias("fetched_at")).crossJoin(now)
    asked = ev.select((F.col("user_id") % 60).alias("work_id"), F.col("event_type").alias("query")).distinct()
    return store.fresh(cache, asked, F.col("now"), 86_400 * 20).select("work_id", "query", "result")


@query("SELECT r_regionkey AS org_id, r_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS members, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def organizations(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("org_id")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"), F.count("*").alias("n"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("org_id"), F.col("r_name").alias("name")).join(nations, "org_id", "left").select("org_id", "name", "members", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, user_id % 20 AS work_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS panel_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_id % 2 = 0")
def panel_events(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("work_id"), F.when(F.col("event_id") % 2 == 0, k).alias("panel_id")).where("panel_id is not null")


@query("""WITH k AS (SELECT user_id, list(DISTINCT event_type) AS roles FROM events GROUP BY 1) SELECT user_id, CAST(len(roles) AS INTEGER) AS n_roles, list_contains(roles, 'purchase') AS buyer, list_contains(roles, 'signup') AS signed_up FROM k WHERE list_contains(roles, 'click')""")
def memory_by_role(spark, sf_dir):
    kept = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("roles"))
    return kept.where(F.array_contains("roles", "click")).select("user_id", F.size("roles").alias("n_roles"), F.array_contains("roles", "purchase").alias("buyer"), F.array_contains("roles", "signup").alias("signed_up"))


_STATE_SQL = "CASE event_type WHEN 'signup' THEN 'user_corrected' WHEN 'purchase' THEN 'verified' WHEN 'click' THEN 'conflicted' ELSE 'auto' END"


def _states(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "signup", "user_corrected").when(kind == "purchase", "verified").when(kind == "click", "conflicted").otherwise("auto").alias("state"))


@query(f"""WITH s AS (SELECT user_id, {_STATE_SQL} AS state FROM events), k AS (SELECT user_id, max(CASE state WHEN 'auto' THEN 0 WHEN 'conflicted' THEN 2 WHEN 'verified' THEN 3 ELSE 4 END) AS k, count(*) FILTER (WHERE state = 'conflicted') AS n_conflicted, count(*) FILTER (WHERE state = 'user_corrected') AS n_user FROM s GROUP BY 1)
SELECT user_id, CASE k WHEN 0 THEN 'auto' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'verified' ELSE 'user_corrected' END AS strongest, n_conflicted, n_user FROM k""")
def strongest_state(spark, sf_dir):
    rank = s.looked_up(F.col("state"), s.STATE_RANK, 0)
    return _states(spark, sf_dir).groupBy("user_id").agg(F.max_by("state", rank).alias("strongest"), F.count_if(F.col("state") == "conflicted").alias("n_conflicted"), F.count_if(F.col("state") == "user_corrected").alias("n_user"))


@query("""WITH c AS (SELECT user_id % 20 AS work_id, user_id AS character_id, count(*) AS appearance_count, CASE WHEN min(event_id) % 2 = 0 THEN min(event_id) END AS first_page FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY appearance_count DESC, first_page NULLS FIRST, character_id) AS position FROM c""")
def character_ranking(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("work_id"), F.col("user_id").alias("character_id")).agg(F.count("*").alias("appearance_count"), F.min("event_id").alias("f"))
    rows = seen.select("work_id", "character_id", "appearance_count", F.when(F.col("f") % 2 == 0, F.col("f")).alias("first_page"))
    return store.listed(rows, ["work_id"], [F.desc("appearance_count"), F.asc_nulls_first("first_page"), "character_id"])


@query("""SELECT s_nationkey AS work_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS by_term, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS newest FROM supplier""")
def store_listings(spark, sf_dir):
    rows = store.listed(table(spark, sf_dir, "supplier").withColumn("work_id", F.col("s_nationkey")), ["work_id"], ["s_name"], name="by_term")
    return store.listed(rows, ["work_id"], [F.desc("s_acctbal"), "s_suppkey"], name="newest").select("work_id", "s_suppkey", "by_term", "newest")


@query("""WITH c AS (SELECT c_nationkey AS work_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer)
SELECT work_id, c_custkey FROM c WHERE position <= 9 + 4 * (work_id % 7 - 1) OR work_id % 7 = 0""")
def scoped_cast(spark, sf_dir):
    cast = store.listed(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("work_id"), "c_custkey"), ["work_id"], ["c_custkey"])
    return store.scope_by(cast, F.col("work_id") % 7).select("work_id", "c_custkey")


@query(f"""WITH e AS ({_EVENTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY page_number DESC, event_id DESC) AS n FROM e) SELECT work_id, event_id, page_number FROM r WHERE n <= 7""")
def last_story_events(spark, sf_dir):
    return m.top_k(_events(spark, sf_dir), ["work_id"], [F.desc("page_number"), F.desc("event_id")], 7).select("work_id", "event_id", "page_number")


@query("""WITH c AS (SELECT p_brand AS work, p_name AS title, 2 AS priority FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, p_type, 1 FROM part UNION ALL SELECT p_brand, p_brand, 0 FROM part)
SELECT work, arg_max(title, (priority, -length(title), title)) AS title FROM c GROUP BY 1""")
def picked_title(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    each = F.array(*(F.struct(F.lit(k).alias("priority"), (-F.char_length(c)).alias("short"), F.col(c).alias("title")) for c, k in (("p_name", 2), ("p_type", 1), ("p_brand", 0))))
    offered = part.select(F.col("p_brand").alias("work"), F.explode(F.filter(each, lambda x: (x["priority"] < 2) | (F.col("p_size") > 25))).alias("c"))
    return offered.groupBy("work").agg(F.max("c").alias("c")).select("work", "c.title")


_LAYER_SQL = """WITH d AS (SELECT source AS work_id, doc_id, CAST(doc_id % 40 AS INTEGER) AS page, lang AS kind, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
a AS (SELECT work_id, 1 AS layer, row_number() OVER (PARTITION BY work_id ORDER BY page DESC, doc_id) AS n, substr(text, 1, 400) AS line FROM d WHERE kind = 'de' AND page <= 20),
b AS (SELECT work_id, 2 AS layer, row_number() OVER (PARTITION BY work_id ORDER BY page, doc_id) AS n, substr(text, 1, 600) AS line FROM d WHERE kind = 'fr' AND abs(page - 20) <= 1),
c AS (SELECT work_id, 3 AS layer, row_number() OVER (PARTITION BY work_id ORDER BY page, doc_id) AS n, substr(text, 1, 120) AS line FROM d WHERE kind = 'en' AND abs(page - 20) <= 1),
u AS (SELECT * FROM a WHERE n <= 1 UNION ALL SELECT * FROM b WHERE n <= 2 UNION ALL SELECT * FROM c WHERE n <= 5)
SELECT work_id, md5(substr(string_agg(line, chr(10) ORDER BY layer, n), 1, 3000)) AS context_md5, CAST(count(*) AS BIGINT) AS n_lines FROM u GROUP BY work_id"""


@query(_LAYER_SQL)
def layered_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    rows = docs.select(F.col("source").alias("work_id"), "doc_id", (F.col("doc_id") % 40).cast("int").alias("page"), F.col("lang").alias("kind"), "text")
    near = F.abs(F.col("page") - 20) <= 1
    layers = [
        r.Layer((F.col("kind") == "de") & (F.col("page") <= 20), [F.desc("page"), F.asc("doc_id")], 1, 400),
        r.Layer((F.col("kind") == "fr") & near, [F.asc("page"), F.asc("doc_id")], 2, 600),
        r.Layer((F.col("kind") == "en") & near, [F.asc("page"), F.asc("doc_id")], 5, 120),
    ]
    return r.layered(rows, ["work_id"], "text", layers, 3000).select("work_id", F.md5("context").alias("context_md5"), "n_lines")


@query("""WITH t AS (SELECT o_custkey AS work_id, o_orderkey AS start_page, 'old' AS source FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT DISTINCT o_custkey AS work_id, o_orderkey - o_orderkey % 2 AS start_page, 'new' AS source FROM orders)
SELECT * FROM t UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.work_id = n.work_id AND t.start_page = n.start_page)""")
def inserted_chapters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    known = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("work_id"), F.col("o_orderkey").alias("start_page"), F.lit("old").alias("source"))
    found = o.select(F.col("o_custkey").alias("work_id"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("start_page"), F.lit("new").alias("source")).distinct()
    return e.insert_missing(known, found, ["work_id", "start_page"])


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_nationkey <> 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def deleted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), F.col("c_nationkey").alias("work_id"))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return store.without(rows, F.col("work_id") == 3, gone, ["key"]).select("key", "value")


@query("SELECT event_type AS kind, user_id % 20 AS work_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY ALL")
def appended_logs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    both = store.appended([ev.where("event_id % 2 = 0"), ev.where("event_id % 3 = 0")])
    return both.groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 20).alias("work_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH c AS (SELECT 'w' AS work_id, c_custkey AS character_id, c_name AS name, CAST(c_custkey % 50 AS INTEGER) AS first_page, CAST(c_custkey % 50 + c_nationkey AS INTEGER) AS last_page, 1 + c_custkey % 4 AS appearance_count, round(c_acctbal, 2) AS confidence, CASE WHEN c_custkey % 5 = 0 AND c_custkey > 5 THEN c_custkey - 1 ELSE c_custkey END AS into_id FROM customer)
SELECT into_id AS character_id, max(name) FILTER (WHERE into_id = character_id) AS name, min(first_page) AS first_page, max(last_page) AS last_page, CAST(coalesce(sum(appearance_count) FILTER (WHERE into_id = character_id), 0) + count(*) FILTER (WHERE into_id <> character_id) AS BIGINT) AS appearance_count, max(confidence) AS confidence FROM c GROUP BY 1""")
def merged_unknowns(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.lit("w").alias("work_id"), k.alias("character_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("description"), (k % 50).cast("int").alias("first_page"), (k % 50 + F.col("c_nationkey")).cast("int").alias("last_page"), (1 + k % 4).alias("appearance_count"), F.round("c_acctbal", 2).alias("confidence"))
    unknown = rows.where("character_id % 5 = 0 AND character_id > 5").select("character_id", (F.col("character_id") - 1).alias("into"))
    return store.merge_characters(rows, unknown).select("character_id", "name", "first_page", "last_page", "appearance_count", "confidence")


@query("""WITH b AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages)
SELECT page_id, CAST(n - 1 AS INTEGER) AS block, length(line) AS n_chars, md5(line) AS value_md5 FROM b WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''""")
def ocr_evidence(spark, sf_dir):
    blocks = table(spark, sf_dir, "pages").select("page_id", F.split("html", "\n").alias("blocks"))
    return store.evidence_rows(blocks, "page_id", "blocks").select("page_id", "block", F.char_length("value").cast("long").alias("n_chars"), F.md5("value").alias("value_md5"))


@query("""WITH r AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1), c AS (SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS given FROM orders GROUP BY 1)
SELECT r.key, coalesce(given, value) AS value, CASE WHEN given IS NULL THEN 'auto' ELSE 'user_corrected' END AS state, CASE WHEN given IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM r LEFT JOIN c ON r.key = c.key""")
def user_corrections(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_type").alias("value"))
    records = e.last_write(log, ["key"], ["event_id"]).select("key", "value", F.lit("auto").alias("state"), F.lit(0.5).alias("confidence"))
    given = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    return store.correct(records, given)


@query("""WITH s AS (SELECT user_id AS work, CAST(event_id % 6 AS INTEGER) AS position, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'completed' ELSE 'pending' END, event_id) AS status FROM events GROUP BY ALL)
SELECT work, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) AS n_stages, bool_and(status = 'completed') AS complete, min(position) FILTER (WHERE status <> 'completed') AS next_pending, round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*), 2)::DOUBLE AS percent FROM s GROUP BY 1""")
def stage_progress(spark, sf_dir):
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("work"), (F.col("event_id") % 6).cast("int").alias("position"), "event_id", F.when(kind.isin("purchase", "click"), "completed").when(kind == "signup", "running").otherwise("pending").alias("status"))
    return jobs.progress(jobs.recovered(e.last_write(log, ["work", "position"], ["event_id"])), ["work"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')")
def pending_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber")
    return jobs.pending(items, done, ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT o_custkey AS work, o_orderkey, o_totalprice FROM orders) SELECT work, count(*) AS n, CASE WHEN sum(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) = 0 THEN 'same' ELSE 'changed' END AS verdict FROM o GROUP BY 1""")
def input_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), "o_orderkey", "o_totalprice")
    after = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    marks = [df.groupBy("work").agg(jobs.mark_of("o_orderkey", "o_totalprice").alias(n), F.count("*").alias(f"n_{n}")) for df, n in ((o, "a"), (after, "b"))]
    return marks[0].join(marks[1], "work").select("work", F.col("n_a").alias("n"), F.when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("verdict"))


@query("""SELECT source AS work_id, count(DISTINCT token) AS n_words, count(*) AS n_seen FROM (SELECT source, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS token, doc_id FROM documents) WHERE length(token) > 3 GROUP BY 1""")
def vocabulary_sizes(spark, sf_dir):
    # Distinct words meet on (work, word) before they are counted, so a work of any size is many keys.
    words = table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("token")).where(F.char_length("token") > 3)
    return words.groupBy("work_id", "token").agg(F.count("*").alias("n")).groupBy("work_id").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_seen"))


@query("SELECT DISTINCT page FROM (SELECT o_orderkey % 1000 AS page FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey % 1000 FROM lineitem WHERE l_returnflag = 'R')")
def discovered_pages(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 1000).alias("page"))
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 1000).alias("page"))
    return a.union(b).distinct()


@query("""SELECT o_custkey AS work, arg_min(o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_clerk, o_orderkey)) AS track FROM orders GROUP BY 1""".replace("o_clerk", "o_orderdate"))
def chosen_track(spark, sf_dir):
    rank = s.looked_up(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, 3)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("work")).agg(F.min_by("o_orderkey", F.struct(rank, "o_orderdate", "o_orderkey")).alias("track"))


@query("""WITH w AS (SELECT o_custkey AS work, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1), c AS (SELECT work, n, unnest(range(n)) AS i FROM w)
SELECT work, CAST(i + 1 AS INTEGER) AS chapter, CAST(round_even(i * (200.0 / n), 0) + 1 AS INTEGER) AS start_page, CAST(CASE WHEN i = n - 1 THEN 200 ELSE greatest(round_even(i * (200.0 / n), 0) + 1, round_even((i + 1) * (200.0 / n), 0)) END AS INTEGER) AS end_page FROM c""".replace("200.0 / n", "CAST(200 AS DOUBLE) / n"))
def even_chapters(spark, sf_dir):
    from ..operators.extraction import even_split

    works = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("work")).agg(F.count("*").cast("int").alias("n"))
    return even_split(works, "work", "n", 200)


@query("SELECT o_orderkey, CAST(o_orderkey % 60 AS DOUBLE) / nullif(o_custkey % 3, 0) AS frames FROM orders")
def frame_rates(spark, sf_dir):
    written = F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit("/"), (F.col("o_custkey") % 3).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.rate(written).alias("frames"))


@query("""SELECT doc_id, substr(sha1(text), 1, 12) AS text_hash, sha256(text) AS input_hash, CAST(list_sum(list_transform(range(1, length(coalesce(source, '')) + 1), lambda i: i * ascii(substr(coalesce(source, ''), i, 1)))) % 7 AS INTEGER) AS seed FROM documents WHERE source IS NOT NULL AND source <> ''""")
def text_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source is not null and source <> ''").select("doc_id", t.short_hash(F.col("text")).alias("text_hash"), F.sha2("text", 256).alias("input_hash"), t.speaker_seed(F.col("source")).cast("int").alias("seed"))


@query("""SELECT user_id, event_id, CASE WHEN n > 0 AND p IS NOT NULL THEN p END AS fallback FROM (SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'click') OVER w AS n, max(CASE WHEN event_type = 'purchase' THEN 'bought' END) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))""")
def provider_fallback(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    ev = table(spark, sf_dir, "events")
    seen = ev.select("user_id", "event_id", F.count_if(F.col("event_type") == "click").over(w).alias("n"), F.max(F.when(F.col("event_type") == "purchase", "bought")).over(w).alias("p"))
    return seen.select("user_id", "event_id", F.when(F.col("n") > 0, F.col("p")).alias("fallback"))
