"""What users look at: kinds of memory, projects, pages and their panels, sound of segments, summaries of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import looked_up
from .sequence import transitions

# Other names of kinds of memory; transitions; engines that stand in for real ones; endings of music, the
# preferred first; the limits of a text probe; importance from which an event is summed up, matters, and leads.
KINDS = {"characters": "character", "char": "character", "person": "character", "places": "world", "place": "world", "object": "world", "objects": "world", "location": "world", "events": "story", "event": "story", "thread": "story", "corrections": "correction", "user": "correction", "books": "book"}
OWN_KINDS = ("character", "world", "story", "correction", "book")
TRANSITIONS = ("cut", "fade", "dissolve")
STAND_INS = ("mock", "dummy")
MUSIC = ("wav", "mp3", "flac", "ogg", "aac", "m4a")
PROBE_PAGES, PROBE_LINES, PROBE_CHARS = 6, 40, 2000
TOLD, MATTERS, LEADS = 0.3, 0.5, 0.6


def kind_of(kind: Column) -> Column:
    """The store of a kind's name: its own, that of another name for it, else character."""
    low = F.lower(F.trim(kind))
    return F.when(low.isin(*OWN_KINDS), low).otherwise(looked_up(low, KINDS, "character"))


def typed(records: DataFrame, kind: str, of: str | None = None) -> DataFrame:
    """Records (kind, value: a map with a type) of one store, of one type if given: threads, places, objects, corrections of a kind."""
    mine = records.where(kind_of(F.col("kind")) == kind)
    return mine if of is None else mine.where(F.try_element_at("value", F.lit("type")) == of)


def typed_transitions(shots: DataFrame, keys: list[str], order: list[str], duration: str, kind: str) -> DataFrame:
    """Adds type, length and overlap of the way from each shot to the next: unknown types are cuts, which take no time; a fade
    takes the time that transitions allows but overlaps nothing; a dissolve overlaps for as long."""
    out = transitions(shots, keys, order, duration).withColumn("type", F.when(F.col(kind).isin(*TRANSITIONS), F.col(kind)).otherwise("cut"))
    length = F.when(F.col("type") == "cut", 0.0).otherwise(F.round("transition", 4))
    return out.withColumns({"length": length, "overlap": F.when(F.col("type") == "dissolve", length).otherwise(0.0)}).drop("transition", "next_duration")


def shot_sources(shots: DataFrame, panels: DataFrame) -> DataFrame:
    """shots (shot_id, primary_panel, panel_ids) with image, width and height of their panel (panels: panel_id, image, width, height): the
    primary one, or the first of panel_ids where none is named. error says what is missing."""
    wanted = shots.withColumn("panel_id", F.coalesce(F.nullif("primary_panel", F.lit("")), F.get("panel_ids", F.lit(0))))
    found = wanted.join(panels.withColumn("__there", F.lit(True)), "panel_id", "left")
    error = F.when(F.col("__there").isNull(), "no panel").when(F.coalesce("image", F.lit("")) == "", "no image").when((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0), "no size")
    return found.select("shot_id", "panel_id", "image", "width", "height", error.alias("error"))


def projects_with_counts(projects: DataFrame, images: DataFrame, records: DataFrame) -> DataFrame:
    """projects (slug, name, cover_file) with cover_url (null where images, slug and file, lack it) and how many records memory holds of
    each kind: one row of counts beside each project."""
    counts = records.agg(*(F.count_if(kind_of(F.col("kind")) == k).alias(f"n_{k}") for k in OWN_KINDS))
    there = images.select("slug", F.col("file").alias("cover_file"), F.lit(True).alias("__there")).distinct()
    named = projects.join(there, ["slug", "cover_file"], "left").withColumn("cover_url", F.when(F.col("__there"), F.concat(F.lit("/images/"), "slug", F.lit("/"), "cover_file")))
    return named.select("slug", F.coalesce(F.nullif("name", F.lit("")), "slug").alias("name"), "cover_url").crossJoin(F.broadcast(counts))


def segment_audio(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (work, position from 0, audio_path) with file: their own if files (work, file) has it, else the one that is named by
    their position, if that is there; entries of neither are left out."""
    usual = F.format_string("segment_%03d.wav", F.col("position") + 1)
    own = F.regexp_extract("audio_path", "([^/]*)$", 1)
    asked = entries.select("work", "position", F.explode(F.array(F.struct(F.lit(0).alias("rank"), own.alias("file")), F.struct(F.lit(1).alias("rank"), usual.alias("file")))).alias("a")).select("work", "position", "a.*")
    met = asked.join(files.select("work", "file").distinct(), ["work", "file"])
    return met.groupBy("work", "position").agg(F.min_by("file", "rank").alias("file"))


def panel_counts(pages: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys) with n_panels, and n_clean of those that are cleaned; 0 for pages without any."""
    each = panels.groupBy(*keys).agg(F.count("*").alias("n_panels"), F.count_if("cleaned").alias("n_clean"))
    return pages.select(*keys).distinct().join(each, keys, "left").fillna(0, ["n_panels", "n_clean"])


def offline(engines: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Whether any engine of a configuration stands in for a real one. Engines that are not named are local."""
    named = [F.coalesce(F.nullif(c, F.lit("")), F.lit("local")) for c in columns]
    return engines.select(*keys, F.exists(F.array(*named), lambda v: v.isin(*STAND_INS)).alias("offline"))


def music_track(files: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, wanted) with track and error: the wanted file if files (keys, file) has it; where none is wanted, the first by
    ending and name."""
    ending = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, MUSIC)), ending)
    first = files.where(rank > 0).groupBy(*keys).agg(F.min_by("file", F.struct(rank, "file")).alias("__first"))
    there = files.select(*keys, F.col("file").alias("wanted"), F.lit(True).alias("__there")).distinct()
    out = asked.join(there, [*keys, "wanted"], "left").join(first, keys, "left")
    track = F.when(F.col("wanted").isNull(), F.col("__first")).when(F.col("__there"), F.col("wanted"))
    return out.select(*keys, "wanted", track.alias("track"), F.when(track.isNull(), F.when(F.col("wanted").isNull(), "no music files").otherwise("not found")).alias("error"))


def text_probe(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """keys, place and line: the distinct lines of three characters or more of a document's first pages, in order, while those before
    have PROBE_CHARS characters at most; of each page the first PROBE_LINES new ones. A document's probe is bounded by its
    first pages."""
    lines = pages.where(F.col(page) < PROBE_PAGES).select(*keys, page, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("at", "line")).withColumn("line", F.trim("line")).where(F.char_length("line") >= 3)
    once = lines.groupBy(*keys, "line").agg(F.min(F.struct(F.col(page).alias("page"), "at")).alias("first"))
    new = once.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "first.page").orderBy("first.at"))).where(F.col("__n") <= PROBE_LINES)
    w = Window.partitionBy(*keys).orderBy("first")
    before = F.coalesce(F.sum(F.char_length("line")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return new.select(*keys, F.row_number().over(w).alias("place"), before.alias("__before"), "line").where(F.col("__before") <= PROBE_CHARS).drop("__before")


def chapter_summaries(chapters: DataFrame, events: DataFrame, characters: DataFrame, keys: list[str]) -> DataFrame:
    """chapters (keys, chapter, start_page, end_page) with short, medium, n_events, important and new_characters. events: keys, chapter, seq,
    description, importance, people (array); characters: keys, name, first_page. The events of a chapter are in order of
    seq, from importance TOLD on; the short text names the first three from LEADS on, or the first three. A chapter's
    events are one text, so they are gathered; chapters hold tens to hundreds."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "description", "importance", "people")))
    told = events.where(F.col("importance") >= TOLD).groupBy(*keys, "chapter").agg(ordered.alias("e"))
    first = characters.where("first_page IS NOT NULL").join(chapters.select(*keys, "chapter", "start_page", "end_page"), keys).where(F.col("first_page").between(F.col("start_page"), F.col("end_page")))
    new = first.groupBy(*keys, "chapter").agg(F.array_sort(F.collect_set("name")).alias("new_characters"))
    out = chapters.join(told, [*keys, "chapter"], "left").join(new, [*keys, "chapter"], "left")
    none = F.col("e").isNull()
    lead = F.filter("e", lambda v: v["importance"] >= LEADS)
    top = F.slice(F.when(F.size(lead) > 0, lead).otherwise(F.col("e")), 1, 3)
    words = lambda a: F.transform(a, lambda v: v["description"])
    head = F.concat(F.lit("Chapter "), F.coalesce(F.col("chapter").cast("string"), F.lit("?")))
    short = F.when(none, F.concat(head, F.lit(": (no significant events detected)"))).otherwise(F.concat_ws(" ", F.concat(head, F.lit(" covers "), F.size("e").cast("string"), F.lit(" key moments.")), words(top)))
    line = F.transform("e", lambda v: F.concat_ws(" · ", F.nullif(F.array_join(F.coalesce(v["people"], F.array().cast("array<string>")), ", "), F.lit("")), v["description"]))
    return out.select(*keys, "chapter", short.alias("short"), F.when(none, "").otherwise(F.array_join(line, "\n")).alias("medium"), F.when(none, 0).otherwise(F.size("e")).cast("long").alias("n_events"), F.array_join(F.coalesce(words(F.filter("e", lambda v: v["importance"] >= MATTERS)), F.array().cast("array<string>")), "|").alias("important"), F.array_join(F.coalesce("new_characters", F.array().cast("array<string>")), "|").alias("new_characters"))


def total_duration(segments: DataFrame, keys: list[str], end: str, pad: float = 0.5) -> DataFrame:
    """keys and seconds: the end of the last segment and a pad."""
    return segments.groupBy(*keys).agg((F.max(end) + pad).alias("seconds"))
