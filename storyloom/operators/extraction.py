"""Facts out of page texts: chapter marks, importance classes, names, headed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import spaces, title_key

# Ways to write a chapter's number (group 1) and perhaps its title (group 2).
CHAPTER_MARKS = (
    r"(?i)(?:chapter|chap\.?|ch\.?|ch)\s*#?\s*(\d+)(?:\s*[:\-\u2013]\s*(.+))?",
    r"#\s*(\d+)(?:\s+([A-Z].+))?",
    r"第\s*(\d+)\s*[話回章]()",
    r"(?i)(?:volume|vol\.?|v\.?)\s*(\d+)\s+(?:chapter|ch\.?|ch)\s*(\d+)",
)
# Words that open a new part of a story, and words of great and of little weight.
OPENERS = ("meanwhile", "later", "the next day", "elsewhere", "several days later", "back at", "the following morning", "翌日", "しかし", "そして", "数日後")
WEIGHTY = ("kill", "death", "die", "battle", "reveal", "betray", "destroy", "transform")
SLIGHT = ("walk", "look", "sit", "stand", "talk")


def _marks(text: Column) -> Column:
    """For each way to write a chapter, its first find: struct(number, title, at: place from 1, 0 for none)."""
    group = lambda p, i: F.regexp_extract(text, p, i)
    return F.array(*(F.struct(F.nullif(group(p, 1), F.lit("")).try_cast("int").alias("number"), F.trim(group(p, 2)).alias("title"), F.regexp_instr(text, F.lit(p)).alias("at")) for p in CHAPTER_MARKS))


def chapter_marks(pages: DataFrame) -> DataFrame:
    """pages (work, page, text): a row for each way to write a chapter that a page has: number, title, source, and
    confidence: .7 with a title, .5 without one, .1 more in the first three tenths of the text, .95 at most."""
    low = spaces(F.col("text"))
    rows = pages.select("work", "page", F.greatest(F.lit(1), F.char_length(low)).alias("n"), F.explode(_marks(low)).alias("m")).where("m.number IS NOT NULL")
    early = (F.col("m.at") - 1) / F.col("n") < 0.3
    sure = F.when(F.col("m.title") != "", 0.7).otherwise(0.5) + F.when(early, 0.1).otherwise(0.0)
    return rows.select("work", "page", "m.number", "m.title", F.least(F.lit(0.95), sure).alias("confidence"), F.lit("ocr").alias("source"))


def title_pages(pages: DataFrame) -> DataFrame:
    """pages (work, page, text, n_panels): those of three panels at most (or of an unknown number) that name a chapter other than
    0, by the first way in which they do; confidence .75."""
    named = F.filter(_marks(spaces(F.col("text"))), lambda m: m["at"] > 0)
    first = F.get(F.filter(named, lambda m: F.coalesce(m["number"], F.lit(0)) > 0), 0)
    few = F.coalesce(F.col("n_panels") <= 3, F.lit(True))
    rows = pages.where(few).select("work", "page", first.alias("m")).where("m IS NOT NULL")
    return rows.select("work", "page", "m.number", "m.title", F.lit(0.75).alias("confidence"), F.lit("title_page").alias("source"))


def opener_marks(pages: DataFrame) -> DataFrame:
    """Pages from the second on whose first 100 characters hold an opening phrase: unnumbered, confidence 0.4."""
    head = F.lower(F.substring(F.col("text"), 1, 100))
    hit = F.exists(F.array(*(F.lit(w) for w in OPENERS)), lambda w: F.contains(head, w))
    return pages.where((F.col("page") >= 2) & hit).select("work", "page", F.lit(None).cast("int").alias("number"), F.lit("").alias("title"), F.lit(0.4).alias("confidence"), F.lit("transition").alias("source"))


def merge_marks(marks: DataFrame, total_pages: int, reach: int = 2) -> DataFrame:
    """Chapters of marks (work, page, number, confidence, source): marks within reach pages of the one before are one,
    at the surest one's page; the unnumbered go on counting; a chapter ends before the next."""
    from .sequence import extents, fill_numbers, gap_groups

    grouped = gap_groups(marks, ["work"], ["page", "confidence", "source"], "page", reach)
    best = grouped.groupBy("work", "group_no").agg(F.max_by(F.struct("page", "number", "confidence"), F.struct("confidence", -F.col("page"))).alias("b"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n_marks"))
    flat = best.select("work", F.col("b.page").alias("start_page"), F.col("b.number").alias("number"), F.col("b.confidence").alias("confidence"), "sources", "n_marks")
    return extents(fill_numbers(flat, ["work"], ["start_page"], "number", "chapter"), ["work"], "start_page", F.lit(total_pages), "end_page").drop("number")


def even_split(works: DataFrame, work: str, n: str, pages: int) -> DataFrame:
    """n chapters of each work over equally many pages, bounds rounded half to even; the last ends with the pages."""
    each = works.select(work, n, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("i"))
    bound = lambda i: F.bround(i * (F.lit(float(pages)) / F.col(n))).cast("int")
    start = bound(F.col("i")) + 1
    end = F.when(F.col("i") == F.col(n) - 1, pages).otherwise(F.greatest(start, bound(F.col("i") + 1)))
    return each.where(F.col(n) > 0).select(work, (F.col("i") + 1).alias("chapter"), start.alias("start_page"), end.alias("end_page"))


def clean_heading(line: Column) -> Column:
    """A heading without tags, its blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "<[^>]*>", " "), r"[ \t\r]+", " "))


def first_link(links: Column, deny: tuple[str, ...]) -> Column:
    """The first of an array of links that holds none of the denied words."""
    return F.get(F.filter(links, lambda v: ~F.lower(v).rlike("|".join(deny))), 0)


def importance(text: Column) -> Column:
    """0.8, 0.3 or 0.5 by weighty and slight words."""
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))
    return F.when(any_of(WEIGHTY), 0.8).when(any_of(SLIGHT), 0.3).otherwise(0.5)


def distinct_texts(rows: DataFrame, keys: list[str], text: str, order: list[str], length: int = 80) -> DataFrame:
    """The first row of each text per key; texts are alike if their first length characters are, but for case and blanks."""
    key = F.substring(F.lower(spaces(F.col(text))), 1, length)
    w = Window.partitionBy(*keys, "__k").orderBy(*order)
    return rows.withColumn("__k", key).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__k", "__r")


def name_counts(rows: DataFrame, keys: list[str], text: str, least: int = 2, k: int = 15) -> DataFrame:
    """The k most frequent capitalised words of each key that come at least that often: name, n, rank."""
    from .matching import top_k

    found = rows.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Z][a-zA-Z]+)"), F.lit(1))).alias("name"))
    counted = found.groupBy(*keys, "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_k(counted, keys, [F.desc("n"), F.desc("name")], k)


def longest_spelling(rows: DataFrame, name: str) -> DataFrame:
    """One spelling of each name (but for case and signs): the longest, then the greatest; and how often it comes."""
    return rows.groupBy(title_key(F.col(name)).alias("name_key")).agg(F.max_by(name, F.struct(F.char_length(name), F.col(name))).alias("name"), F.count("*").alias("n"))


def headed_blocks(rows: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """Lines of a text by the heading above them: key, block (0 before the first heading), title, n_lines, body_chars.
    heading: a pattern whose group 1 is the title."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("title", F.regexp_extract("line", heading, 1))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum((F.col("title") != "").cast("int")).over(w))
    return numbered.groupBy(key, "block").agg(F.max("title").alias("title"), F.sum((F.col("title") == "").cast("int")).alias("n_lines"), F.sum(F.when(F.col("title") == "", F.char_length("line")).otherwise(0)).alias("body_chars"))
