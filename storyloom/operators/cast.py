"""The cast of a work from wiki pages: headings, leaf sections with their first sentence, and links by frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Headings that begin a cast, and sections that are groups though nothing stands below them.
CAST_HEADINGS = ("main characters", "major characters", "heroes", "protagonists", "secondary characters", "supporting characters", "antagonists", "villains", "cast", "characters", "overview")
GROUPS = ("sound four", "kara", "divine trees", "tailed beasts", "ototsuki clan")
# Sections that end a page's cast; what stands around links of actors and media; labels that are none of
# the cast, and words that make a label a medium's.
TAILS = ("Reception", "References", "Notes", "Video game", "Easter Egg", "External links", "Footer")
CREDITS = r"(?i)\bvoic(?:ed|e)?\b|dubb?ed?\b|voice actress|dub (?:part|cast|x)?|(?:English|Japanese) (?:dub|voice|ver)|provided by|(?:television|radio|company|uhder|anime series)"
NO_NAMES = ("one piece", "naruto", "manga", "anime")
PLAIN_WORDS = ("the", "to", "of", "in", "and", "for", "an", "a", "on", "japan", "japanese", "english", "world", "series", "island", "mermen", "straw hats", "straw hat", "anime", "manga")
MEDIA = ("netflix", "hollywood", "television", "tv", "production", "company", "media", "news wire", "hewlett", "buzzfeed")
#: Characters before and behind the begin of a link that tell whether it is a credit.
BEFORE, BEHIND = 70, 90


def sections(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, block (from 1), level (2 to 6), heading and body of the sections of wiki texts. What stands before the first
    heading is in no section. A page is one document, so its lines are ordered in one window. A heading has a text that
    neither begins nor ends with the sign of its marks: a line of other marks left and right is none. Lines end at \\n alone."""
    line = r"(?d)^[ \t\r]*(={2,6})[ \t\r]*([^=](?:.*[^= \t\r])?)[ \t\r]*\1[ \t\r]*$"
    lines = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).withColumn("mark", F.regexp_extract("line", line, 1))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum((F.col("mark") != "").cast("long")).over(w)).where("block > 0")
    head = F.col("mark") != ""
    rest = F.array_sort(F.collect_list(F.when(~head, F.struct("at", "line"))))
    title = F.max(F.when(head, F.regexp_extract("line", line, 2)))
    return numbered.groupBy(*keys, "block").agg(F.max(F.length("mark")).cast("int").alias("level"), F.trim(title).alias("heading"), F.array_join(F.transform(rest, lambda r: r["line"]), "\n").alias("body"))


def plain_heading(heading: Column) -> Column:
    """A heading without tags, italics and brackets."""
    bare = F.regexp_replace(heading, "<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("''")), r"\[\[|\]\]", " "), r"\s+", " "))


def first_sentence(body: Column, name: Column, limit: int = 160) -> Column:
    """The first sentence of a section that is longer than five characters and no credit, without the name and the verb
    that it begins with; empty where there is none."""
    text = F.regexp_replace(body, r"\{\{[^{}]*\}\}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<ref[^>]*>.*?</ref>", " "), "<[^>]+>", " ")
    text = F.replace(F.regexp_replace(text, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), F.lit("''"))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[\\[\\]\"‘’“”]", " "), r"\s+", " "))
    told = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: (F.char_length(F.trim(s)) > 5) & ~s.rlike(r"(?i)\bvoiced by\b"))
    told = F.coalesce(F.trim(F.get(told, 0)), F.lit(""))

    def without(sentence: Column, lead: Column) -> Column:
        begins = (F.char_length(lead) > 0) & F.startswith(F.lower(sentence), F.lower(lead))
        return F.when(begins, F.ltrim(F.substring(sentence, F.char_length(lead) + 1, F.char_length(sentence)), F.lit(",;: "))).otherwise(sentence)

    first = F.when(F.contains(name, F.lit(" ")), F.substring_index(name, " ", 1)).otherwise("")
    rest = without(without(told, name), first)
    return F.substring(F.regexp_replace(rest, r"(?i)^(?:is|are|was|been|being)\s+", ""), 1, limit)


def cast_of(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, name and role of the people of pages whose second-level headings name a cast: the third-level sections that
    have no deeper ones below them, but for GROUPS. Of names alike but for case, the longest, then the first."""
    blocks = sections(pages, keys, text)
    low = F.lower(plain_heading(F.col("heading")))
    grouped = blocks.where((F.col("level") == 2) & low.isin(*CAST_HEADINGS)).select(*keys).distinct()
    after = F.lead("level").over(Window.partitionBy(*keys).orderBy("block"))
    people = blocks.withColumn("next", after).where((F.col("level") == 3) & (F.coalesce("next", F.lit(0)) <= 3)).withColumn("name", plain_heading(F.col("heading")))
    people = people.where((F.char_length("name") >= 2) & ~F.lower("name").isin(*GROUPS)).join(grouped, keys, "left_semi")
    once = people.groupBy(*keys, F.lower("name").alias("low")).agg(F.min_by(F.struct("name", "body"), F.struct((-F.char_length("name")).alias("n"), "block")).alias("b"))
    return once.select(*keys, F.col("b.name").alias("name"), first_sentence(F.col("b.body"), F.col("b.name")).alias("role"))


def linked_names(pages: DataFrame, keys: list[str], order: str, text: str, most: int = 40, least: int = 2) -> DataFrame:
    """keys, name, n and rank of the labels of [[links]] in wiki texts that may be people: the `most` frequent (ties: the
    one met first, by order and place) of those that are no file, no credit and long enough, less those that come
    fewer than `least` times, are plain words, of more than four words, or a medium's. rank counts those left, from 1."""
    cut = F.col(text)
    for tail in TAILS:
        cut = F.substring_index(cut, f"\n=={tail}", 1)
    pieces = F.split(cut, r"\[\[")
    begin = F.aggregate(pieces, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, p: F.struct((a["at"] + F.char_length(p) + 2).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))["all"]
    each = pages.select(*keys, order, cut.alias("__t"), F.posexplode(F.arrays_zip(pieces.alias("piece"), begin.alias("at"))).alias("i", "z")).where("i > 0")
    each = each.withColumn("raw", F.regexp_extract("z.piece", r"^([^\[\]]+)\]\]", 1)).where("raw <> ''")
    start = F.col("z.at") - 3  # characters before the link's brackets
    around = F.substring("__t", F.greatest(F.lit(1), start - BEFORE + 1), F.when(start < BEFORE, start + BEHIND).otherwise(BEFORE + BEHIND))
    target = F.trim(F.substring_index("raw", "|", 1))
    label = F.trim(F.coalesce(F.nullif(F.substring_index("raw", "|", -1), F.lit("")), target))
    fits = ~F.contains("raw", F.lit(":")) & ~F.startswith(F.lower("raw"), F.lit("file")) & ~F.contains(target, F.lit("(")) & (target != "") & ~around.rlike(CREDITS) & (F.char_length(label) >= 3) & ~F.lower(label).isin(*NO_NAMES)
    counted = each.where(fits).select(*keys, label.alias("name"), F.struct(order, "i").alias("met")).groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min("met").alias("met"))
    top = counted.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "met"))).where(F.col("__r") <= most)
    low = F.lower("name")
    kept = top.where((F.col("n") >= least) & ~low.isin(*PLAIN_WORDS) & (F.size(F.split(F.trim("name"), r"\s+")) <= 4) & ~low.rlike("|".join(MEDIA)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__r"))).select(*keys, "name", "n", "rank")
