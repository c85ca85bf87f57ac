"""Queries on people: aliases in texts, candidates, memories of a name, and casts of wiki pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases as a
from ..operators import cast as c
from .registry import query, table
from .story import _MEMORY_TOKENS_SQL


@query("""WITH a AS (SELECT DISTINCT lower(substr(text, CAST(1 + item_id % 20 AS INTEGER), CAST(1 + item_id % 9 AS INTEGER))) AS alias FROM benchmark), t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT DISTINCT doc_id, alias FROM t, a WHERE alias <> '' AND contains(t, alias)""")
def alias_mentions(spark, sf_dir):
    """Pieces of benchmark texts, of one to nine characters, wherever documents hold them."""
    i = F.col("item_id")
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.substring("text", (1 + i % 20).cast("int"), (1 + i % 9).cast("int"))).alias("alias"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return a.mentions(texts, "doc_id", "text", names)


_FUZZY = "((length(x) >= 6 AND length(y) >= 6 AND (contains(x, y) OR contains(y, x))) OR ((contains(x, ' ') OR contains(y, ' ')) AND split_part(x, ' ', 1) = split_part(y, ' ', 1) AND regexp_full_match(split_part(x, ' ', 1), '[a-z]+')))"


@query(f"""WITH n AS (SELECT p_size AS k, p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(split_part(p_name, ' ', 1)) WHEN 2 THEN p_name || 's' ELSE 'Unknown 3' END AS name FROM part),
c AS (SELECT p_size AS k, p_partkey AS place, p_name AS candidate, 'the ' || lower(p_type) || ' of ' || p_name AS description FROM part),
s AS (SELECT n.p_partkey, place, candidate, CASE WHEN x = y THEN 1.0 WHEN {_FUZZY} THEN 0.7 WHEN contains(d, x) THEN 0.6 END AS score FROM n JOIN c USING (k), LATERAL (SELECT lower(name) AS x, lower(candidate) AS y, lower(description) AS d) WHERE p_partkey % 4 <> 3),
b AS (SELECT * FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, place) = 1)
SELECT n.p_partkey, n.name, candidate, CAST(score AS DOUBLE) AS score FROM n LEFT JOIN b USING (p_partkey)""")
def candidate_scores(spark, sf_dir):
    """Names of parts against the parts of the same size."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper(F.substring_index("p_name", " ", 1))).when(k == 2, F.concat("p_name", F.lit("s"))).otherwise("Unknown 3")
    known = part.select(F.col("p_size").alias("k"), F.col("p_partkey").alias("place"), F.col("p_name").alias("candidate"), F.concat(F.lit("the "), F.lower("p_type"), F.lit(" of "), "p_name").alias("description"))
    return a.identified(part.select(F.col("p_size").alias("k"), "p_partkey", name.alias("name")), known, ["k"]).select("p_partkey", "name", "candidate", "score")


@query(f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM benchmark), al AS (SELECT t[2] AS alias, min(t[4]) AS canonical FROM w WHERE len(t) >= 4 GROUP BY 1),
q AS (SELECT DISTINCT t[2] AS name FROM w WHERE len(t) >= 2), n AS (SELECT name, name AS token FROM q UNION SELECT name, canonical FROM q JOIN al ON name = alias),
r AS (SELECT conv_id * 1000 + turn AS record, CASE WHEN turn % 3 > 0 THEN turn END AS page, unnest({_MEMORY_TOKENS_SQL}) AS token FROM conversations WHERE text IS NOT NULL),
m AS (SELECT DISTINCT name, record, page FROM n JOIN r USING (token))
SELECT name, record, page, CAST(row_number() OVER (PARTITION BY name ORDER BY page DESC NULLS LAST, record) AS INTEGER) AS rank FROM m QUALIFY rank <= 6""")
def remembered_names(spark, sf_dir):
    """Turns that hold a name or its canonical spelling, six a name."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)).alias("t"))
    spelt = words.where(F.size("t") >= 4).select(F.get("t", F.lit(1)).alias("alias"), F.get("t", F.lit(3)).alias("canonical"))
    asked = words.where(F.size("t") >= 2).select(F.get("t", F.lit(1)).alias("name"))
    talk = table(spark, sf_dir, "conversations").where("text is not null")
    record = F.col("conv_id") * 1000 + F.col("turn")
    return a.remembered_of(talk.select(record.alias("record"), record.alias("place"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("page"), "text"), asked, spelt)


_WIKI_SQL = """wiki AS (SELECT page_id, CASE WHEN page_id % 4 < 3 THEN '== Main Characters ==' || chr(10) ELSE '==Islands==' || chr(10) END || replace(replace(replace(replace(replace(html, '<h1>', chr(10) || '==='), '</h1>', '===' || chr(10)), '<p><b>', chr(10) || CASE WHEN page_id % 2 = 0 THEN '====Member====' ELSE '===Hero ' || page_id || '===' END || chr(10)), '<br>', chr(10) || '=== Second ' || page_id % 7 || ' ===' || chr(10) || 'Second ' || page_id % 7 || ' is '), '<p>', chr(10)) AS t FROM pages)"""


def _wiki(spark, sf_dir):
    """Web pages as wiki texts: their tags become headings of three levels under one that names a cast, or none."""
    p = F.col("page_id")
    number = (p % 7).cast("string")
    text = F.replace(F.replace("html", F.lit("<h1>"), F.lit("\n===")), F.lit("</h1>"), F.lit("===\n"))
    text = F.replace(text, F.lit("<p><b>"), F.concat(F.lit("\n"), F.when(p % 2 == 0, "====Member====").otherwise(F.concat(F.lit("===Hero "), p.cast("string"), F.lit("==="))), F.lit("\n")))
    text = F.replace(text, F.lit("<br>"), F.concat(F.lit("\n=== Second "), number, F.lit(" ===\nSecond "), number, F.lit(" is ")))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(p % 4 < 3, "== Main Characters ==\n").otherwise("==Islands==\n"), F.replace(text, F.lit("<p>"), F.lit("\n"))).alias("text"))


_LINE = r"^[ \t\r]*{m}[ \t\r]*([^=](?:.*[^= \t\r])?)[ \t\r]*{m}[ \t\r]*$"
_LEVEL = " ".join(f"WHEN regexp_matches(line, '{_LINE.format(m='=' * n)}') THEN {n}" for n in (2, 3, 4))
_HEAD = " ".join(f"WHEN {n} THEN regexp_extract(line, '{_LINE.format(m='=' * n)}', 1)" for n in (2, 3, 4))


@query(rf"""WITH {_WIKI_SQL}, l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM wiki),
v AS (SELECT *, CASE {_LEVEL} END AS level FROM l), n AS (SELECT *, CASE level {_HEAD} END AS head, count(level) OVER (PARTITION BY page_id ORDER BY pos) AS block FROM v),
b AS (SELECT page_id, block, max(level) AS level, max(head) AS heading, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level IS NULL), '') AS body FROM n WHERE block > 0 GROUP BY ALL),
h AS (SELECT *, trim(regexp_replace(regexp_replace(replace(regexp_replace(heading, '<[^>]+>', '', 'g'), '''''', ''), '\[\[|\]\]', ' ', 'g'), '\s+', ' ', 'g')) AS name, lead(level) OVER (PARTITION BY page_id ORDER BY block) AS nxt FROM b),
g AS (SELECT DISTINCT page_id FROM h WHERE level = 2 AND lower(name) = 'main characters'),
p AS (SELECT h.* FROM h SEMI JOIN g USING (page_id) WHERE level = 3 AND coalesce(nxt, 0) <= 3 AND length(name) >= 2),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY length(name) DESC, block) = 1),
c AS (SELECT page_id, name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\{{\{{[^{{}}]*\}}\}}', ' ', 'g'), '(?s)<ref[^>]*>.*?</ref>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\[\]"‘’“”]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM o),
s AS (SELECT page_id, name, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 5) AS told FROM c),
f AS (SELECT page_id, name, coalesce(trim(told[1]), '') AS told FROM s),
x AS (SELECT page_id, name, CASE WHEN starts_with(lower(told), lower(name)) THEN ltrim(substr(told, length(name) + 1), ',;: ') ELSE told END AS told, CASE WHEN contains(name, ' ') THEN split_part(name, ' ', 1) ELSE '' END AS lead FROM f),
y AS (SELECT page_id, name, CASE WHEN lead <> '' AND starts_with(lower(told), lower(lead)) THEN ltrim(substr(told, length(lead) + 1), ',;: ') ELSE told END AS told FROM x)
SELECT page_id, name, substr(regexp_replace(told, '(?i)^(?:is|are|was|been|being)\s+', ''), 1, 160) AS role FROM y""")
def page_casts(spark, sf_dir):
    return c.cast_of(_wiki(spark, sf_dir), ["page_id"], "text")


@query(r"""WITH w AS (SELECT page_id % 10 AS work, page_id, regexp_replace(CASE WHEN page_id % 6 = 0 THEN 'Voiced by ' ELSE '' END || html, '<a href="/([^"]*)">([^<]*)</a>', '[[\1|\2]]', 'g') AS t FROM pages),
s AS (SELECT *, string_split(t, '[[') AS ps FROM w), e AS (SELECT work, page_id, t, ps, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM s),
p AS (SELECT *, sum(length(piece) + 2) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) - 2 AS pos FROM e),
r AS (SELECT work, page_id, i, regexp_extract(piece, '^([^\[\]]+)\]\]', 1) AS raw, substr(t, CAST(greatest(1, pos - 2 - 70 + 1) AS INTEGER), CAST(CASE WHEN pos - 2 < 70 THEN pos - 2 + 90 ELSE 160 END AS INTEGER)) AS around FROM p WHERE i > 1),
l AS (SELECT *, trim(split_part(raw, '|', 1)) AS target, trim(CASE WHEN string_split(raw, '|')[-1] = '' THEN split_part(raw, '|', 1) ELSE string_split(raw, '|')[-1] END) AS label FROM r WHERE raw <> ''),
k AS (SELECT work, label AS name, count(*) AS n, min((page_id, i)) AS met FROM l WHERE NOT contains(raw, ':') AND NOT starts_with(lower(raw), 'file') AND NOT contains(target, '(') AND target <> '' AND NOT regexp_matches(around, '(?i)\bvoic(?:ed|e)?\b|dubb?ed?\b|voice actress|dub (?:part|cast|x)?|(?:English|Japanese) (?:dub|voice|ver)|provided by|(?:television|radio|company|uhder|anime series)') AND length(label) >= 3 AND lower(label) NOT IN ('one piece', 'naruto', 'manga', 'anime') GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY n DESC, met) AS r FROM k QUALIFY r <= 40)
SELECT work, name, n, CAST(row_number() OVER (PARTITION BY work ORDER BY r) AS INTEGER) AS rank FROM t WHERE n >= 2 AND lower(name) NOT IN ('the','to','of','in','and','for','an','a','on','japan','japanese','english','world','series','island','mermen','straw hats','straw hat','anime','manga') AND len(regexp_split_to_array(trim(name), '\s+')) <= 4 AND NOT regexp_matches(lower(name), 'netflix|hollywood|television|tv|production|company|media|news wire|hewlett|buzzfeed')""")
def linked_casts(spark, sf_dir):
    """Links of ten groups of pages, of which one in six begins with a credit."""
    p = F.col("page_id")
    text = F.regexp_replace(F.concat(F.when(p % 6 == 0, "Voiced by ").otherwise(""), "html"), '<a href="/([^"]*)">([^<]*)</a>', "[[$1|$2]]")
    return c.linked_names(table(spark, sf_dir, "pages").select((p % 10).alias("work"), "page_id", text.alias("text")), ["work"], "page_id", "text")
