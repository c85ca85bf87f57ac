"""Learning from pages and references: what a page's pictures say goes into memory and the store, with its evidence."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import elide, whole_id
from .entities import first_known, fold, last_known
from .store import Store

# Names that are none, the share of trust that a model's and a reference's facts have, and the metadata
# fields that are evidence.
NO_NAMES = ("", "unknown", "unk", "n/a")
NO_THINGS = (*NO_NAMES, "none")
BY_MODEL, BY_CAST, BY_BOOK = 0.5, 0.7, 0.8
FIELDS = ("title", "author", "genres", "status", "synopsis")
MODEL, NET = "vlm", "internet"
FACTS = 40


def learned(panels: DataFrame) -> DataFrame:
    """panels (work_id, page, visual) as what they teach: work_id, page, kind (character, place, object, event), key, value. Blank and
    unknown names teach nothing; each of a panel's lists is exploded, never gathered."""
    visual = F.col("visual")
    base = ["work_id", "page"]
    person = panels.select(*base, F.explode(visual["characters"]).alias("p")).select(*base, F.lit("character").alias("kind"), F.trim("p.name").alias("key"), F.nullif(F.trim(F.substring("p.description", 1, 120)), F.lit("")).alias("value"))
    one = lambda kind, c: panels.select(*base, F.lit(kind).alias("kind"), F.trim(c).alias("key"), F.trim(c).alias("value"))
    thing = panels.select(*base, F.explode(visual["objects"]).alias("o")).select(*base, F.lit("object").alias("kind"), F.trim("o").alias("key"), F.trim("o").alias("value"))
    rows = reduce(DataFrame.unionByName, (person, one("place", visual["environment"]), thing, one("event", visual["important_event"])))
    none = F.when(F.col("kind") == "character", F.lower("key").isin(*NO_NAMES)).otherwise(F.lower("key").isin(*NO_THINGS))
    return rows.where(F.col("key").isNotNull() & ~none)


def evidence(rows: DataFrame, kind: str, key: Column, value: Column, source: str, confidence: float, page: Column | None = None) -> DataFrame:
    """Rows of source_evidence: an id that the row's own facts give, so the same evidence twice is one id."""
    at = F.lit(None).cast("int") if page is None else page.cast("int")
    told = rows.select("work_id", F.lit(kind).alias("entity_type"), key.alias("entity_key"), value.alias("value"), F.lit(source).alias("source_type"), at.alias("pdf_page"), F.lit(confidence).alias("confidence"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("work_id", "entity_type", "entity_key", "value", "source_type", "pdf_page")]
    return told.withColumn("evidence_id", whole_id("ev", *parts))


def _seen_again(known: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] = ()) -> DataFrame:
    """Rows of entities as they are after new sightings: the first name, the last of what is overwritten, pages that widen, counts that
    add up, the greatest confidence."""
    columns = [c for c in new.columns if c not in keys]
    both = known.join(new.select(*keys), keys, "left_semi").select(*keys, *columns, F.lit(0).alias("__t")).unionByName(new.withColumn("__t", F.lit(1)))
    how = {"first_page": F.min("first_page"), "last_page": F.max("last_page"), "appearance_count": F.sum("appearance_count").cast("int"), "confidence": F.max("confidence")}
    rest = {c: last_known(c, ["__t"]) if c in overwrite else first_known(c, ["__t"]) for c in columns if c not in how}
    return both.groupBy(*keys).agg(*((how | rest)[c].alias(c) for c in columns))


def ingest_pages(store: Store, panels: DataFrame, batch: int = 0) -> None:
    """Pages into the store: characters, locations and events by key, with the pages on which they were seen first and last and
    how often; evidence of every sighting of a character; and a checkpoint a page. Each table is one write that carries
    the batch's number, so a run that died between two tables is run again under the same number, and the tables that
    have it are left as they are. Numbers rise."""
    mark = ("ingest", batch)
    seen = learned(panels).withColumn("page", F.col("page").cast("int"))
    kind = lambda k: seen.where(F.col("kind") == k)
    people = kind("character").withColumns({"character_id": whole_id("char", F.col("work_id"), F.lower("key")), "first_page": F.col("page"), "last_page": F.col("page"), "confidence": F.lit(BY_MODEL)})
    key = ["work_id", "character_id"]
    folded = fold(people.withColumnsRenamed({"key": "name", "value": "description"}), key, ["page", "name", "description"], overwrite=["description"], fill=["name"], least=["first_page"], most=["last_page", "confidence"], count="appearance_count")
    store.upsert("characters", _seen_again(store.table("characters"), folded, key, ["description"]), mark=mark)
    store.log("source_evidence", evidence(people, "character", F.col("character_id"), F.coalesce("value", "key"), MODEL, BY_MODEL, F.col("page")), mark)
    places = kind("place").withColumns({"location_id": whole_id("loc", F.col("work_id"), F.lower("key")), "first_page": F.col("page"), "last_page": F.col("page")})
    key = ["work_id", "location_id"]
    located = fold(places.withColumnRenamed("key", "name"), key, ["page", "name"], fill=["name"], least=["first_page"], most=["last_page"], count="appearance_count")
    store.upsert("locations", _seen_again(store.table("locations"), located, key), mark=mark)
    happened = kind("event").select("work_id", whole_id("evt", F.col("work_id"), F.col("page").cast("string"), F.col("key")).alias("event_id"), F.col("page").alias("page_number"), F.lit("event").alias("event_type"), F.col("key").alias("description"))
    store.upsert("events", happened.distinct(), mark=mark)
    done = panels.select("work_id", F.lit("ingest").alias("stage"), F.col("page").cast("string").alias("key_value"), F.lit("completed").alias("status")).distinct()
    store.upsert("processing_checkpoints", done, mark=mark)


def store_references(store: Store, books: DataFrame) -> None:
    """books (work_id, title, author, genres, status, synopsis): those with a title are put into works, and each field that says
    something is evidence. Fields are unpivoted, so a table of any length is one pass."""
    named = books.where(F.coalesce(F.trim("title"), F.lit("")) != "")
    store.upsert("works", named.select("work_id", *FIELDS))
    text = {f: F.array_join(f, ", ") if dict(books.dtypes)[f].startswith("array") else F.col(f).cast("string") for f in FIELDS}
    each = named.select("work_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.substring(c, 1, 500).alias("value")) for f, c in text.items()))).alias("e")).where("coalesce(e.value, '') <> ''")
    store.log("source_evidence", evidence(each, "metadata", F.col("e.field"), F.col("e.value"), NET, BY_BOOK))


def store_cast(store: Store, cast: DataFrame) -> None:
    """cast (work_id, name, role, description): characters by name, role and description cut to their lengths, and evidence of each."""
    named = cast.withColumn("name", F.trim("name")).where("coalesce(name, '') <> ''").withColumn("character_id", whole_id("char", F.col("work_id"), F.lower("name")))
    rows = named.select("work_id", "character_id", "name", F.nullif(F.substring("role", 1, 100), F.lit("")).alias("role"), F.nullif(F.substring("description", 1, 200), F.lit("")).alias("description"), F.lit(BY_CAST).alias("confidence"))
    store.upsert("characters", rows)
    told = F.concat(F.lit("Name: "), "name", F.lit(", Role: "), F.coalesce("role", F.lit("")))
    store.log("source_evidence", evidence(named, "character", F.col("character_id"), told, NET, BY_CAST))


def remembered_facts(log: DataFrame, key: str, seq: str, n: int = FACTS) -> DataFrame:
    """log (key, seq, page, fact): the facts of each key as lines, in the order in which they came, the last n. A line that is among
    those kept is not added; one that has been pushed out may come again. Blank and unknown facts are none; a page of
    0 or null is not named. A key streams through its task, which holds n lines."""
    fact = elide(F.col("fact"), limit=220)
    line = F.when(F.coalesce(F.col("page"), F.lit(0)) > 0, F.concat(F.lit("page p."), F.col("page").cast("string"), F.lit(": "), fact)).otherwise(fact)
    kind = log.schema[key].dataType.simpleString()

    def run(batches):
        at, kept, some, id_type = None, [], False, None

        def table(done):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], id_type), pa.array([v for _, v in done], pa.list_(pa.string()))], names=[key, "facts"])

        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not some or k != at:
                    if some:
                        done.append((at, kept))
                    at, kept, some = k, [], True
                if text not in kept:
                    kept = [*kept, text][-n:]
            if done:
                yield table(done)
        if some:
            yield table([(at, kept)])

    rows = log.select(key, seq, line.alias("line")).where("line IS NOT NULL").repartition(key).sortWithinPartitions(key, seq, "line")
    return rows.select(key, "line").mapInArrow(run, f"`{key}` {kind}, facts array<string>")
