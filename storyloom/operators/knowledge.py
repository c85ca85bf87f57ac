"""From page artifacts to knowledge rows, narration segments and planned shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.scoring import coverage, looked_up
from ..functions.text import elide, plan_tokens, strip_answer, to_confidence, to_text
from .rules import errors
from .shots import score_parts

# What a segment may say about its picture and its camera.
INTENTS = ("full_panel", "multi_panel", "smart_crop", "face_closeup", "character_closeup", "object_closeup", "action_crop")
CAMERAS = ("static", "slow_zoom_in", "slow_zoom_out", "pan_left", "pan_right", "pan_up", "pan_down")
KINDS = ("narration", "dialogue")
# The form of a panel's id, and the weights of the signals that plan a shot.
PANEL_ID = r"^p\d{3}_\d{3}$"
PLAN_WEIGHTS = {"character": 0.25, "action": 0.15, "event": 0.20, "object": 0.10, "ocr": 0.15, "story": 0.15}


def panel_errors() -> Column:
    """Names of what is wrong with a knowledge row."""
    b = F.col("bbox")
    return errors({
        "panel_id": F.col("panel_id").rlike(PANEL_ID),
        "page": F.col("page") >= 1,
        "reading_order": F.col("reading_order").isNull() | (F.col("reading_order") >= 1),
        "bbox": g.box(b).isNotNull() & (F.get(b, 0) >= 0) & (F.get(b, 1) >= 0),
        "confidence": F.col("visual.confidence").isNull() | F.col("visual.confidence").between(0, 1),
    })


def page_errors(pages: DataFrame) -> DataFrame:
    """Pages whose panel count or reading direction does not hold."""
    return pages.withColumn("errors", errors({"panel_count": F.size("panels") == F.col("panel_count"), "direction": F.col("reading_direction").isin("rtl", "ltr")})).where(F.size("errors") > 0)


def as_list(value: Column) -> Column:
    """A JSON value as strings: an array's elements, a scalar alone, nothing for null."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(value, "array<string>"), F.array(value)))


def coerce_visual(answer: Column) -> Column:
    """A model's JSON answer as the fixed visual struct, whatever it left out or misspelt."""
    at = lambda p: F.get_json_object(answer, f"$.{p}")
    person = "array<struct<name:string,description:string,action:string,emotion:string>>"
    people = F.coalesce(F.from_json(at("characters"), person), F.array().cast(person))
    clean = F.transform(people, lambda p: F.struct(*(to_text(p[k]).alias(k) for k in ("name", "description", "action", "emotion"))))
    texts = [to_text(at(k)).alias(k) for k in ("environment", "important_event", "composition", "story_relevance")]
    return F.struct(clean.alias("characters"), *texts, *(as_list(at(k)).alias(k) for k in ("actions", "objects", "visual_effects")), to_confidence(at("confidence")).alias("confidence"))


def build_records(panels: DataFrame, order: DataFrame, ocr: DataFrame, visual: DataFrame) -> DataFrame:
    """panels (page, panel_id, ...) with their rank, text and picture, where there are any, and their neighbours in
    order of rank (the unranked last)."""
    key = ["page", "panel_id"]
    joined = panels.join(order, key, "left").join(ocr, key, "left").join(visual, key, "left")
    w = Window.partitionBy("page").orderBy(F.col("rank").asc_nulls_last(), "panel_id")
    return joined.select("*", F.lag("panel_id").over(w).alias("previous_panel"), F.lead("panel_id").over(w).alias("next_panel"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Panels of after that are new or have another row hash than before."""
    mark = lambda df: df.select("page", "panel_id", F.xxhash64(*sorted(df.columns)).alias("h"))
    return mark(after).join(mark(before), ["page", "panel_id", "h"], "left_anti").select("page", "panel_id")


def known_characters(panels: DataFrame) -> DataFrame:
    """A row for each character seen in a panel: page, panel_id, n, name, description, action, emotion; unknown names
    become a placeholder of the panel."""
    rows = panels.select("page", "panel_id", F.posexplode("visual.characters").alias("n", "c")).select("page", "panel_id", "n", "c.*")
    return rows.withColumn("name", F.coalesce(elide(F.col("name")), F.concat(F.lit("Unknown_"), "panel_id")))


def page_characters(panels: DataFrame) -> DataFrame:
    """Characters of each page: attributes of their first panel, and in how many panels they are."""
    order = F.struct("panel_id", "n")
    return known_characters(panels).groupBy("page", "name").agg(*(F.min_by(c, order).alias(c) for c in ("description", "emotion")), F.countDistinct("panel_id").alias("appearance_count"))


def profiles(panels: DataFrame, texts: int = 6, roles: int = 4) -> DataFrame:
    """Characters over all pages: first page, appearances, their first distinct descriptions and actions."""
    known = known_characters(panels)
    first = lambda c: known.where(elide(F.col(c)).isNotNull()).groupBy("name", c).agg(F.min(F.struct("page", "panel_id", "n")).alias("seq"))

    def best(c: str, k: int, name: str) -> DataFrame:
        # One row a distinct value, so a character of any number of panels is small before it is gathered.
        ranked = first(c).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("seq"))).where(F.col("r") <= k)
        return ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(c).alias("v")))), lambda s: s["v"]).alias(name))

    seen = known.groupBy("name").agg(F.min("page").alias("first_seen_page"), F.count("*").alias("appearances"))
    return seen.join(best("description", texts, "descriptions"), "name", "left").join(best("action", roles, "roles"), "name", "left")


def finalize_scenes(panels: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Scenes of panels (location, characters, event, confidence, rank): extent, panels in order, distinct facts, mean
    confidence, and a factual summary of at most `most` items a kind."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("characters", F.array().cast("array<string>"))))))
    facts = panels.groupBy(*keys).agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("page", "rank", "panel_id"))), lambda p: p["panel_id"]).alias("panel_ids"),
        names.alias("characters"), F.array_sort(F.collect_set("location")).alias("locations"), F.array_sort(F.collect_set("event")).alias("events"),
        F.coalesce(F.bround(F.avg("confidence"), 4), F.lit(0.0)).alias("confidence"),
    )
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, most), ", ")))
    return facts.withColumn("summary", F.concat_ws(". ", part("Characters: ", "characters"), part("Locations: ", "locations"), part("Events: ", "events")))


def segments(raw: DataFrame, known: DataFrame, default_importance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """raw (scene_id, position, text, panel_ids, estimated_seconds, visual_intent, camera, importance, type, speaker),
    known (scene_id, ids): the good segments, cleaned and numbered in order, and the rejected with their errors."""
    given = raw.join(known, "scene_id", "left").withColumns({
        "text": strip_answer(F.col("text")),
        "seconds": F.col("estimated_seconds").try_cast("double"),
        "visual_intent": F.coalesce("visual_intent", F.lit("smart_crop")),
        "camera": F.coalesce("camera", F.lit("static")),
        "type": F.coalesce("type", F.lit("narration")),
        "weight": F.coalesce(F.col("importance").cast("string"), F.lit(str(default_importance))).try_cast("double"),
        "panel_ids": F.array_distinct("panel_ids"),
    })
    checks = {
        "text": F.col("text") != "", "panel_ids": F.size(F.array_except("panel_ids", "ids")) == 0, "seconds": F.col("seconds") > 0,
        "visual_intent": F.col("visual_intent").isin(*INTENTS), "camera": F.col("camera").isin(*CAMERAS), "type": F.col("type").isin(*KINDS), "importance": F.col("weight").isNotNull(),
    }
    judged = given.withColumn("errors", errors(checks))
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("position"))
    speaker = F.when(F.col("type") == "dialogue", to_text(F.col("speaker")))
    good = judged.where(F.size("errors") == 0).select("scene_id", F.format_string("seg_%03d", number).alias("segment_id"), "type", "text", "panel_ids", F.bround("seconds", 1).alias("estimated_seconds"), "visual_intent", "camera", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight"))), 3).alias("importance"), speaker.alias("speaker"))
    return good, judged.where(F.size("errors") > 0).select("scene_id", "position", "errors")


def panel_score(text: Column, weights: dict[str, float] = PLAN_WEIGHTS) -> Column:
    """How well a panel (visual, ocr) fits a segment's text."""
    words = plan_tokens(text)
    hit = lambda c: F.coalesce(F.size(F.array_intersect(plan_tokens(F.array_join(c, " ")), words)) > 0, F.lit(False)).cast("double")
    story = F.col("visual.story_relevance").try_cast("double")
    return score_parts(hit(F.transform("visual.characters", lambda p: p["name"])), hit(F.col("visual.actions")), hit(F.array("visual.important_event")), hit(F.col("visual.objects")), F.coalesce(coverage(plan_tokens(F.col("ocr.text")), words), F.lit(0.0)), F.when(story.between(0, 1), story), weights)


def plan_shots(segs: DataFrame, panels: DataFrame, review: float = 0.55, tie: float = 0.02, floor: float = 0.90) -> DataFrame:
    """segs (page, scene_id, segment_id, text, panel_ids, estimated_seconds), panels (page, scene_id, panel_id, visual,
    ocr): the panel of each segment. Named panels score at least floor; without one, the panels of the scene compete,
    or those of the page where the scene has none. A tie or a score under review asks for review."""
    named = segs.select("*", F.explode("panel_ids").alias("panel_id")).join(panels.select("page", "panel_id", "visual", "ocr"), ["page", "panel_id"])
    named = named.withColumn("score", F.greatest(F.lit(floor), panel_score(F.col("text")))).withColumn("explicit", F.lit(True))
    rest = segs.join(named.select("segment_id", "scene_id").distinct(), ["scene_id", "segment_id"], "left_anti")
    in_scene = rest.join(panels.select("page", "scene_id", "panel_id", "visual", "ocr"), ["page", "scene_id"])
    alone = rest.join(panels.select("page", "scene_id").distinct(), ["page", "scene_id"], "left_anti")
    on_page = alone.join(panels.select("page", "panel_id", "visual", "ocr"), "page")
    pool = in_scene.unionByName(on_page.select(*in_scene.columns)).withColumn("score", panel_score(F.col("text"))).withColumn("explicit", F.lit(False))
    keep = ["page", "scene_id", "segment_id", "panel_id", "estimated_seconds", "score", "explicit"]
    w = Window.partitionBy("scene_id", "segment_id").orderBy(F.desc("score"), "panel_id")
    both = named.select(*keep).unionByName(pool.select(*keep))
    best = both.select("*", F.lead("score").over(w).alias("next_score"), F.lead("panel_id").over(w).alias("next_panel"), F.row_number().over(w).alias("r")).where("r = 1")
    close = F.coalesce(F.col("score") - F.col("next_score") < tie, F.lit(False))
    flag = ~F.col("explicit") & (close | (F.col("score") < review))
    return best.select("page", "scene_id", "segment_id", F.col("panel_id").alias("primary_panel"), "estimated_seconds", F.round("score", 4).alias("match_score"), F.when(close & ~F.col("explicit"), F.col("next_panel")).alias("secondary_panel"), flag.alias("needs_review"))


def scene_linked(records: DataFrame, keys: list[str], place: str, starts: Column) -> DataFrame:
    """Adds previous_panel, next_panel (the neighbours' places) and scene_id, s and the number of starts so far, to the
    records of a page."""
    w = Window.partitionBy(*keys).orderBy(place)
    number = F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return records.select("*", F.lag(place).over(w).alias("previous_panel"), F.lead(place).over(w).alias("next_panel"), F.concat(F.lit("s"), number.cast("string")).alias("scene_id"))


def valid_intent(raw: Column, default: str = "smart_crop") -> Column:
    return F.when(raw.isin(*INTENTS), raw).otherwise(F.lit(default))


def unit_or(value: Column, default: float) -> Column:
    """A number in 0 to 1, else the default."""
    number = value.try_cast("double")
    return F.when(number.between(0, 1), number).otherwise(F.lit(default))


def camera_zoom(camera: Column) -> Column:
    """Start and end zoom of a camera move; unknown moves stand still."""
    zoom = lambda start, end: F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return F.when(camera == "slow_zoom_in", zoom(1.0, 1.25)).when(camera == "slow_zoom_out", zoom(1.25, 1.0)).otherwise(zoom(1.0, 1.0))


def crop_of(width: Column, height: Column, regions: Column, critical: float = 0.6, aspect: float = 16 / 9) -> Column:
    """regions (array of structs box, weight): the window of an aspect around all regions of at least critical weight,
    if one fits (strategy 16_9); else their own box (safe_wider); without such regions the middle of the panel."""
    chosen = F.transform(F.filter(regions, lambda r: r["weight"] >= critical), lambda r: r["box"])
    around = g.union_box(chosen)
    whole = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), width.alias("w"), height.alias("h"))
    wide, high = F.least(width.cast("double"), height * F.lit(aspect)), F.least(height.cast("double"), width / F.lit(aspect))
    middle = F.struct(((width - wide) / 2).alias("x"), ((height - high) / 2).alias("y"), wide.alias("w"), high.alias("h"))
    fits = (around["w"] <= wide) & (around["h"] <= high)
    as_double = lambda b: F.struct(*(b[k].cast("double").alias(k) for k in "xywh"))
    box = F.when(around.isNull(), middle).when(fits, g.aspect_crop(F.coalesce(around, whole), width, height, aspect)).otherwise(as_double(around))
    return F.struct(box.alias("box"), F.when(around.isNull() | fits, "16_9").otherwise("safe_wider").alias("strategy"))
