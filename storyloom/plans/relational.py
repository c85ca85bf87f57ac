"""Queries on joins, entity upserts, conflicts and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as s
from ..functions import text as t
from ..operators import entities as e
from ..operators import matching as m
from ..operators import ledger, states
from ..operators import retrieval as r
from .registry import query, table
from .story import _MEMORY_TOKENS_SQL, _TOKENS_SQL

_LINKS_SQL = "SELECT DISTINCT o_orderkey AS panel, l_suppkey AS segment FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"


def _links(spark, sf_dir):
    """Orders as panels, suppliers as segments that name them in their returned lines."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("panel"), F.col("l_suppkey").alias("segment"))


_MAP_SQL = f"""WITH k AS ({_LINKS_SQL}), z AS (SELECT segment, count(*) AS c FROM k GROUP BY 1), p AS (SELECT panel, count(*) AS n, max(c) AS most FROM k JOIN z USING (segment) GROUP BY 1),
m AS (SELECT o_orderkey AS panel, coalesce(n, 0) AS n_groups, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'one_to_many' WHEN most > 1 THEN 'many_to_one' ELSE 'one_to_one' END AS cardinality FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN p ON o_orderkey = panel)"""


@query(_MAP_SQL + " SELECT * FROM m")
def match_panels(spark, sf_dir):
    panels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("panel"))
    return m.mapping(panels, _links(spark, sf_dir), "panel", "segment")


@query(_MAP_SQL + " SELECT cardinality, count(*) AS n_panels, CAST(sum(n_groups) AS BIGINT) AS n_links FROM m GROUP BY 1")
def match_summary(spark, sf_dir):
    return match_panels(spark, sf_dir).groupBy("cardinality").agg(F.count("*").alias("n_panels"), F.sum("n_groups").alias("n_links"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unknown_references(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return m.unknown_links(known, lines, "l_partkey")


@query("SELECT l_partkey, string_agg(k, ',' ORDER BY k) AS segments, count(*) AS n FROM (SELECT DISTINCT l_partkey, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS k FROM lineitem) GROUP BY l_partkey")
def reverse_index(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("k")).distinct()
    return pairs.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("segments"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, c_name, n_name, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 1 END NULLS LAST, o_orderkey) AS position
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def knowledge_build(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    first = F.when(F.col("o_orderpriority").startswith("1"), 1).asc_nulls_last()
    joined = orders.join(customers, "o_custkey", "left").join(nations, "c_nationkey", "left")
    return joined.select("o_orderkey", "c_name", "n_name", F.row_number().over(Window.partitionBy("o_custkey").orderBy(first, "o_orderkey")).cast("long").alias("position"))


@query("""WITH b AS (SELECT p_partkey * 7 AS lo, p_partkey * 7 + 9 AS hi, p_brand AS label FROM part),
m AS (SELECT o_orderkey, lo, label, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo NULLS LAST, label NULLS LAST) AS n FROM orders LEFT JOIN b ON o_orderkey BETWEEN lo AND hi) SELECT o_orderkey, lo, label FROM m WHERE n = 1""")
def band_lookup(spark, sf_dir):
    bands = table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("lo"), (F.col("p_partkey") * 7 + 9).alias("hi"), F.col("p_brand").alias("label"))
    return m.lookup_in_ranges(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", bands, "lo", "hi", 64, ["label"]).select("o_orderkey", "lo", "label")


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY 1) SELECT first_key // 1000 AS band, count(*) AS n_new, min(o_custkey) AS least_customer FROM f GROUP BY 1""")
def first_seen_in_band(spark, sf_dir):
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"))
    return firsts.groupBy(F.floor(F.col("first_key") / 1000).alias("band")).agg(F.count("*").alias("n_new"), F.min("o_custkey").alias("least_customer"))


@query("""WITH a AS (SELECT 'C' || (c_custkey % 500) AS alias, min(c_custkey) AS entity_id FROM customer GROUP BY 1),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || (o_orderkey % 700) ELSE (SELECT min(c_name) FROM customer c WHERE c.c_custkey = o_custkey) END AS name FROM orders)
SELECT o_orderkey, coalesce(a.entity_id, c.id) AS entity_id FROM n LEFT JOIN a ON name = alias LEFT JOIN (SELECT c_name, min(c_custkey) AS id FROM customer GROUP BY 1) c ON name = c_name""")
def alias_resolve(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    aliases = customers.select(F.concat(F.lit("C"), (F.col("c_custkey") % 500).cast("string")).alias("alias"), F.col("c_custkey").alias("entity_id"))
    orders = table(spark, sf_dir, "orders").join(customers.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left")
    names = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("C"), (F.col("o_orderkey") % 700).cast("string"))).otherwise(F.col("c_name")).alias("name"))
    return m.resolve_names(names, "name", aliases, customers.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"))).select("o_orderkey", "entity_id")


_FUZZY_SQL = "(x = y OR (length(x) >= 6 AND length(y) >= 6 AND (contains(x, y) OR contains(y, x))) OR ((contains(x, ' ') OR contains(y, ' ')) AND split_part(x, ' ', 1) = split_part(y, ' ', 1) AND regexp_full_match(split_part(x, ' ', 1), '[a-z]+')))"


@query(f"""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE '' END AS name FROM part),
c AS (SELECT p_name AS entity_name, min(p_partkey) AS id FROM part GROUP BY 1),
h AS (SELECT name, id FROM n, c, LATERAL (SELECT lower(name) AS x, lower(entity_name) AS y) WHERE {_FUZZY_SQL})
SELECT n.name, min(id) AS entity_id FROM n LEFT JOIN h ON n.name = h.name GROUP BY n.name""")
def fuzzy_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat(F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_type"))).otherwise(F.lit(""))).alias("name")).distinct()
    known = part.groupBy(F.col("p_name").alias("entity_name")).agg(F.min("p_partkey").alias("entity_id")).withColumn("rank", F.col("entity_id"))
    return m.resolve_fuzzy(names, "name", known, t.name_blocks("n", "e"), t.name_blocks("e", "n"))


@query("""SELECT c_mktsegment, event_type, count(DISTINCT user_id) AS n_users, count(*) AS n_events FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY ALL""")
def page_characters(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    people = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return table(spark, sf_dir, "events").join(people, "user_id").groupBy("c_mktsegment", "event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n_events"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality, CASE WHEN l.doc_id IS NULL THEN 'text only' WHEN d.doc_id IS NULL THEN 'label only' ELSE 'both' END AS found
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def notes_overlay(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(True).alias("has_text"))
    n = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("has_label"))
    found = F.when(F.col("has_label").isNull(), "text only").when(F.col("has_text").isNull(), "label only").otherwise("both")
    return d.join(n, "doc_id", "full").select("doc_id", "lang", "quality", found.alias("found"))


@query("SELECT c_custkey, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS sources FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def kb_sources(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(kinds, "c_custkey", "left").withColumn("sources", F.coalesce("sources", F.lit("")))


@query("""WITH i AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 600 + CAST(floor(value) AS BIGINT) * 60 AS e, event_type FROM events)
SELECT a.event_id AS a_id, b.event_id AS b_id, least(a.e, b.e) - greatest(a.s, b.s) AS seconds FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND a.s < b.e AND b.s < a.e""")
def interval_overlap(spark, sf_dir):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    at = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds.alias("s"), (seconds + 600 + F.floor("value") * 60).alias("e"))
    a, b = (at.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "click"))
    met = m.overlaps(a, b, ["user_id"], "s", "e", 21_600)
    return met.select(F.col("l.event_id").alias("a_id"), F.col("r.event_id").alias("b_id"), (F.least("l.e", "r.e") - F.greatest("l.s", "r.s")).alias("seconds"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, max(event_id) AS signup FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT p.event_id, s.signup AS signup_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_active(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    states = events.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("event_id").alias("signup"))
    facts = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return m.as_of(facts, states, ["user_id"], "ts", "event_id", "signup", "signup_id").select("event_id", "signup_id")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _TABLES))
def store_stats(spark, sf_dir):
    return e.counts({n: table(spark, sf_dir, n) for n in _TABLES})


@query("""SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS appearances,
(SELECT string_agg(event_type, ',' ORDER BY f) FROM (SELECT event_type, min(event_id) AS f FROM events x WHERE x.user_id = e.user_id GROUP BY 1 ORDER BY f LIMIT 4)) AS roles FROM events e GROUP BY user_id""")
def entity_profile(spark, sf_dir):
    # First sight of each role, then at most four a user: the arrays are bounded by the number of roles.
    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"), F.max("event_id").alias("l"), F.count("*").alias("n"))
    roles = e.distinct_first(F.collect_list(F.struct(F.col("f").alias("seq"), F.col("event_type").alias("v"))), 4)
    return kinds.groupBy("user_id").agg(F.min("f").alias("first_seen"), F.max("l").alias("last_seen"), F.sum("n").alias("appearances"), F.array_join(roles, ",").alias("roles"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2) DESC, event_id) AS n FROM events WHERE round(value, 2) >= 50) SELECT user_id, string_agg(event_type || '#' || event_id, ' | ' ORDER BY n) AS summary FROM r WHERE n <= 3 GROUP BY 1""")
def page_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.round("value", 2)).where("v >= 50")
    best = m.top_k(rows, ["user_id"], [F.desc("v"), F.asc("event_id")], 3)
    line = F.concat("event_type", F.lit("#"), F.col("event_id").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return best.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " | ").alias("summary"))


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS role, min(event_id) AS first_page, max(event_id) AS last_page, count(*) AS appearance_count, round(max(value), 4) AS confidence FROM events GROUP BY 1""")
def upsert_fold(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", t.elide(F.col("event_type"), unknown=("view",)).alias("role"), F.col("event_id").alias("first_page"), F.col("event_id").alias("last_page"), F.round("value", 4).alias("confidence"))
    return e.fold(log, ["user_id"], ["event_id"], overwrite=["role"], least=["first_page"], most=["last_page", "confidence"], count="appearance_count")


@query("SELECT user_id, event_type, arg_max(round(value, 4), event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))
    return e.last_write(log, ["user_id", "event_type"], ["event_id"])


@query("SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_acctbal > 0) AS segment, arg_max(c_name, c_custkey) AS title, count(*) AS n FROM customer GROUP BY 1")
def fill_missing(spark, sf_dir):
    log = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_name").alias("title"))
    return e.fold(log, ["c_nationkey"], ["c_custkey"], overwrite=["title"], fill=["segment"], count="n")


_CONFLICT_SQL = """WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS a, min(event_id) AS i FROM events GROUP BY 1),
l AS (SELECT e.user_id, arg_min(event_type, event_id) AS b, min(event_id) AS j FROM events e JOIN f USING (user_id) WHERE event_type <> f.a GROUP BY 1),
c AS (SELECT user_id, a AS value_a, CASE i % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'pdf' WHEN 2 THEN 'internet' ELSE 'ocr' END AS source_a, b AS value_b, CASE j % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'pdf' WHEN 2 THEN 'internet' ELSE 'ocr' END AS source_b FROM f JOIN l USING (user_id))"""


@query(_CONFLICT_SQL + " SELECT * FROM c")
def conflict_open(spark, sf_dir):
    n = F.col("event_id") % 4
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(n == 0, "user").when(n == 1, "pdf").when(n == 2, "internet").otherwise("ocr").alias("source"))
    return e.open_conflicts(log, ["user_id"], ["event_id"], "event_type", "source")


@query(_CONFLICT_SQL + """ SELECT *, CASE WHEN source_a = 'user' THEN value_a WHEN source_b = 'user' THEN value_b WHEN source_a = 'internet' THEN value_a WHEN source_b = 'internet' THEN value_b WHEN source_a = 'pdf' THEN value_a ELSE value_b END AS resolved_value,
CASE WHEN 'user' IN (source_a, source_b) THEN 'user' ELSE 'auto' END AS resolved_by FROM c""")
def conflict_resolve(spark, sf_dir):
    return e.resolve_conflicts(conflict_open(spark, sf_dir), "internet")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), b AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def snapshot_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderdate < timestamp_ntz'2000-01-01'").select("o_orderkey", "o_orderstatus")
    after = o.where("o_orderdate >= timestamp_ntz'1996-01-01'").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return e.diff(before, after, ["o_orderkey"])


@query("""WITH b AS (SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS note FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 3000 THEN 'new' END AS segment, 'n' || c_custkey AS note FROM customer WHERE c_nationkey < 10)
SELECT coalesce(b.id, n.id) AS id, coalesce(n.segment, b.segment) AS segment, coalesce(n.note, b.note) AS note FROM b FULL JOIN n ON b.id = n.id""")
def snapshot_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    before = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("note"))
    new = c.where("c_nationkey < 10").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 3000, "new").alias("segment"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("note"))
    return e.merge_snapshot(before, new, ["id"])


_STEP_SQL = """list_reduce(list_transform(seen, lambda s: {'value': s.value, 'state': 'auto', 'n': 1, 'page': s.page}), lambda a, b: {
 'value': CASE WHEN a.value <> b.value AND a.state = 'conflicted' THEN b.value ELSE a.value END,
 'state': CASE WHEN a.value = b.value THEN a.state WHEN a.state = 'conflicted' THEN 'auto' ELSE 'conflicted' END, 'n': a.n + 1, 'page': b.page})"""


@query(f"""WITH l AS (SELECT user_id AS key, list({{'value': event_type, 'page': event_id}} ORDER BY event_id) AS seen FROM events GROUP BY 1), f AS (SELECT key, {_STEP_SQL} AS m FROM l)
SELECT key, m.value AS value, m.state AS state, CAST(m.n AS INTEGER) AS seen_count, CAST(m.page AS INTEGER) AS page FROM f""")
def memory_state_fold(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.lit("auto").alias("state"), F.lit(0.5).alias("confidence"), F.col("event_id").cast("int").alias("page"))
    return states.fold_states(log, "key", "seq").select("key", "value", "state", "seen_count", "page")


@query(f"""WITH q AS (SELECT item_id, {_MEMORY_TOKENS_SQL} AS qt FROM benchmark), d AS (SELECT doc_id, {_MEMORY_TOKENS_SQL} AS toks, text FROM documents WHERE text IS NOT NULL),
x AS (SELECT item_id, unnest(qt) AS token FROM q), y AS (SELECT doc_id, unnest(toks) AS token FROM d), h AS (SELECT item_id, doc_id, count(*) AS hits FROM x JOIN y USING (token) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM h) SELECT item_id, doc_id, hits, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def keyword_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark")
    return r.keyword_hits(table(spark, sf_dir, "documents"), queries, "doc_id", "item_id", "text", 5).select("item_id", "doc_id", "hits", "rank")


_BEST_SQL = f"""WITH q AS (SELECT item_id, {_TOKENS_SQL} AS qt FROM benchmark), d AS (SELECT doc_id, {_TOKENS_SQL} AS toks, text FROM documents WHERE text IS NOT NULL),
x AS (SELECT item_id, len(qt) AS n, unnest(qt) AS token FROM q), y AS (SELECT doc_id, unnest(toks) AS token FROM d), s AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM x JOIN y USING (token) GROUP BY ALL),
r AS (SELECT *, lead(doc_id) OVER w AS d2, lead(score) OVER w AS s2, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id))
SELECT item_id, doc_id AS best, score AS best_score, CASE WHEN score - s2 < 0.02 THEN d2 END AS second, coalesce(score - s2 < 0.02, false) OR score < 0.55 AS needs_review FROM r WHERE n = 1"""


@query(_BEST_SQL)
def best_match(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").withColumn("toks", t.tokens(F.col("text"))).select("item_id", F.size("toks").alias("n"), F.explode("toks").alias("token"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokens(F.col("text"))).alias("token"))
    scored = q.join(d, "token").groupBy("item_id", "doc_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    return m.best_two(scored, ["item_id"], "score", "doc_id", 0.02, 0.55)


@query(f"""WITH d AS (SELECT doc_id, source, {_MEMORY_TOKENS_SQL} AS toks, n_chars FROM (SELECT *, lang || ' ' || text AS t0 FROM documents WHERE text IS NOT NULL)),
v AS (SELECT *, list_value('character','place','object','event','name','location','the_story') AS w FROM d),
s AS (SELECT source, doc_id, round(0.5 * len(list_intersect(list_value('character','place','object','event','name','location','that','with','nicht','pour')[1:6], toks)) / 6.0 + 0.35 * least(1.0, n_chars / 4000.0) * CASE doc_id % 3 WHEN 0 THEN 0.98 WHEN 1 THEN 0.85 ELSE 0.35 END + 0.15 * greatest(0.0, 1.0 - abs(doc_id % 100 - 50) / 30.0), 9) AS score FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s) SELECT source, doc_id AS key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def retrieve_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    n = F.col("doc_id") % 3
    records = d.select("source", F.col("doc_id").alias("key"), F.col("text").alias("value"), (F.col("doc_id") % 100).cast("int").alias("page"), (F.col("n_chars") / 4000.0).alias("confidence"), F.when(n == 0, "verified").when(n == 1, "auto").otherwise("conflicted").alias("state"))
    words = F.array(*(F.lit(w) for w in r.TASKS["narration"]))
    score = 0.5 * r.relevance(words, F.col("value")) + 0.35 * s.effective_confidence(F.col("confidence"), F.col("state")) + 0.15 * s.page_boost(F.col("page"), F.lit(50))
    return m.top_k(records.withColumn("score", F.round(score, 9)), ["source"], [F.desc("score"), F.asc("key")], 8).select("source", "key", F.round("score", 6).alias("score"), "rank")


_LEDGER_SQL = """WITH ent AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'metadata' ELSE 'character' END AS kind, CASE WHEN c_custkey % 5 > 0 THEN ' V' || c_custkey % 3 ELSE '' END AS value FROM customer),
ev AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'correct' WHEN 'error' THEN 'resolve' ELSE 'evidence' END AS event, CASE WHEN event_type <> 'error' THEN 'v' || event_id % 3 END AS value,
 CASE WHEN event_type = 'signup' THEN 'user' ELSE list_element(['pdf', 'internet', 'ocr', 'user'], CAST(event_id // 5 % 4 AS INTEGER) + 1) END AS source, CASE WHEN event_type = 'signup' THEN 1.0 ELSE event_id % 7 / 10.0 END::DOUBLE AS confidence FROM events),
lg AS (SELECT *, coalesce(sum(CASE WHEN event <> 'evidence' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch, last_value(CASE WHEN event = 'correct' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS given,
 max(CASE WHEN event <> 'resolve' THEN {'c': confidence, 's': -seq, 'source': source} END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS surest, min(CASE WHEN event <> 'resolve' THEN {'c': confidence, 's': -seq, 'source': source} END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS least FROM ev),
m AS (SELECT lg.*, ent.kind, coalesce(given, ent.value) AS value_a FROM lg JOIN ent USING (key) WHERE event = 'evidence' AND trim(coalesce(given, ent.value)) <> '' AND lower(trim(coalesce(given, ent.value))) <> lower(trim(lg.value))),
o AS (SELECT *, count(*) OVER (PARTITION BY key, stretch) AS n_met FROM m QUALIFY row_number() OVER (PARTITION BY key, stretch ORDER BY seq) = 1),
e AS (SELECT key, stretch, event, value, source, seq FROM lg WHERE event <> 'evidence'),
j AS (SELECT o.key, o.stretch, value_a, CASE WHEN kind = 'metadata' THEN least.source ELSE surest.source END AS source_a, o.value AS value_b, o.source AS source_b, o.seq AS opened, n_met, e.event, e.value AS v, e.source AS p, e.seq AS closed FROM o LEFT JOIN e ON e.key = o.key AND e.stretch = o.stretch)"""


@query(_LEDGER_SQL + """ SELECT key, row_number() OVER (PARTITION BY key ORDER BY stretch) AS number, value_a, source_a, value_b, source_b, opened, n_met, closed,
CASE event WHEN 'correct' THEN v WHEN 'resolve' THEN CASE WHEN source_a = 'user' THEN value_a WHEN source_b = 'user' THEN value_b WHEN source_a = p THEN value_a WHEN source_b = p THEN value_b WHEN source_a = 'pdf' THEN value_a ELSE value_b END END AS resolved_value,
CASE WHEN event IS NOT NULL THEN CASE WHEN event = 'correct' OR 'user' IN (source_a, source_b) THEN 'user' ELSE 'auto' END END AS resolved_by FROM j""")
def conflict_ledger(spark, sf_dir):
    return ledger.conflict_ledger(*_ledger(spark, sf_dir), ["key"])[0]


@query("""SELECT c_custkey AS key, coalesce(arg_max('v' || event_id % 3, event_id) FILTER (WHERE event_type = 'signup'), any_value(CASE WHEN c_custkey % 5 > 0 THEN ' V' || c_custkey % 3 ELSE '' END)) AS value FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1
UNION ALL SELECT user_id, arg_max('v' || event_id % 3, event_id) FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def corrected_values(spark, sf_dir):
    return ledger.conflict_ledger(*_ledger(spark, sf_dir), ["key"])[1]


def _ledger(spark, sf_dir):
    """Customers as entities, events as evidence about them, resolutions and corrections."""
    k = F.col("c_custkey")
    stored = table(spark, sf_dir, "customer").select(k.alias("key"), F.when(k % 2 == 0, "metadata").otherwise("character").alias("kind"), F.when(k % 5 > 0, F.concat(F.lit(" V"), (k % 3).cast("string"))).otherwise("").alias("value"))
    i = F.col("event_id")
    event = F.when(F.col("event_type") == "signup", "correct").when(F.col("event_type") == "error", "resolve").otherwise("evidence")
    source = F.element_at(F.array(*map(F.lit, ("pdf", "internet", "ocr", "user"))), (F.floor(i / 5) % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), i.alias("seq"), event.alias("event"), F.when(F.col("event_type") != "error", F.concat(F.lit("v"), (i % 3).cast("string"))).alias("value"), source.alias("source"), (i % 7 / F.lit(10.0)).alias("confidence"))
    return stored, log


_EVENT_STEP_SQL = """list_reduce(list_prepend({'e': '', 'value': CAST(NULL AS VARCHAR), 'state': 'none', 'n': 0, 'page': CAST(NULL AS BIGINT)}, list_transform(seen, lambda s: {'e': s.e, 'value': s.value, 'state': 'auto', 'n': 1, 'page': s.page})), lambda a, b: {'e': '',
 'value': CASE WHEN b.e = 'delete' THEN NULL WHEN b.e = 'correct' OR a.state = 'none' THEN b.value WHEN a.state <> 'user_corrected' AND a.value <> b.value AND a.state = 'conflicted' THEN b.value ELSE a.value END,
 'state': CASE WHEN b.e = 'delete' THEN 'none' WHEN b.e = 'correct' THEN 'user_corrected' WHEN a.state = 'none' THEN 'auto' WHEN a.state = 'user_corrected' OR a.value = b.value THEN a.state WHEN a.state = 'conflicted' THEN 'auto' ELSE 'conflicted' END,
 'n': CASE WHEN b.e = 'delete' THEN 0 ELSE a.n + 1 END, 'page': CASE WHEN b.e = 'delete' THEN NULL WHEN b.e = 'correct' THEN a.page ELSE coalesce(b.page, a.page) END})"""


@query(f"""WITH l AS (SELECT user_id % 400 AS key, list({{'e': CASE WHEN event_id % 41 = 0 THEN 'delete' WHEN event_id % 53 = 0 THEN 'correct' ELSE 'observe' END, 'value': event_type, 'page': CASE WHEN event_id % 3 > 0 THEN event_id END}} ORDER BY event_id) AS seen FROM events GROUP BY 1), f AS (SELECT key, {_EVENT_STEP_SQL} AS m FROM l)
SELECT key, m.value AS value, m.state AS state, CAST(m.n AS INTEGER) AS seen_count, CAST(m.page AS INTEGER) AS page FROM f WHERE m.state <> 'none'""")
def memory_events(spark, sf_dir):
    """Records through observations, the user's corrections and deletions."""
    i = F.col("event_id")
    event = F.when(i % 41 == 0, "delete").when(i % 53 == 0, "correct").otherwise("observe")
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 400).alias("key"), i.alias("seq"), event.alias("event"), F.col("event_type").alias("value"), F.lit("auto").alias("state"), F.lit(0.5).alias("confidence"), F.when(i % 3 > 0, i).cast("int").alias("page"))
    return states.fold_states(log, "key", "seq").select("key", "value", "state", "seen_count", "page")
