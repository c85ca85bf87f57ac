"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, positions, unused, word_count

#: The schedule is the golden-ratio sequence in integers: slot k sits at (k * STEP mod PERIOD) / PERIOD, where
#: STEP is the odd number next to PERIOD / 1.6180339887. The products stay below 2**62, so nothing overflows.
PERIOD = 2**31
STEP = 1_327_217_885


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sizes: source, source_size (long). Adds target (double): sources in code-point order, null last, weigh
    weights in turn and share the sum of all sizes; a target stops at cap times its source's size, and the excess
    goes to the others by weight until none is above. Each round is one small aggregate whose four sums reach the
    driver; rounds end when no source is newly stopped. Only the source table (a row a source) is ordered whole."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(sizes.select("source", "source_size", w.alias("weight")), "sources")
    full = F.col("source_size") * F.lit(float(cap))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:
        stopped = F.lit(rate) * F.col("weight") > full if rate else F.lit(False)
        held, free = table.agg(F.sum(F.when(stopped, full).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        new = (total - held) / free if free else rate
        if not free or new <= rate:
            break
        rate = new
    return table.select("source", "source_size", "weight", F.least(F.lit(rate) * F.col("weight"), full).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block_words: int | None = None, slack: float = 0.02) -> dict:
    """docs needs doc_id, source and size (long, words); other columns are ignored. Returns a dict of

    placed: doc_id, source, size, start: a document's words are [start, start + size) of its source's shuffled stream;
    sources: source, source_size, target, quota (words to take);
    schedule: slot, source, turn: the slot takes block turn of its source. Block b holds the words
    [b * block_words, (b + 1) * block_words) of the source's stream, repeated pass after pass; the last block is cut at
    the quota. A source that the sequence gives fewer slots than blocks has its last ones at the end of the schedule;
    block_words: as given, or 1 to 256, so that a mix of any size has 65,536 slots or more where it has the words.

    Null sources are one source; null sizes count as 0; empty tables give empty results; equal rows count each."""
    spark = docs.sparkSession
    slim = materialize(docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "mix-docs")
    sources = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    total, n_sources = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block = block_words or max(1, min(256, int(total) >> 16))
    sources = materialize(sources.select("source", "source_size", "target", F.floor(F.col("target") + 1e-6).alias("quota")), "mix-sources")
    placed = materialize(positions(slim, ["source"], ["doc_id", "size"], {"start": F.col("size")}), "mix-placed")
    # Cumulative weights cut [0, PERIOD) into a range a source; a slot's point picks the range that it falls in.
    slots = int(total / block * (1 + slack)) + 512 if total else 0
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total or 1.0) * PERIOD
    ranges = sources.withColumn("hi", upto).withColumn("lo", F.coalesce(F.lag("hi").over(in_order), F.lit(0.0)))
    point = F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(STEP), F.lit(PERIOD))
    grid = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    # Both sides meet on equal cells of [0, PERIOD), at least one a source; a source has a row for each cell it touches.
    cells = 1 << max(10, int(n_sources).bit_length())
    width = PERIOD // cells
    cell = lambda c: F.least(F.floor(F.col(c) / width), F.lit(cells - 1))
    touched = ranges.where("target > 0").select("source", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    dealt = grid.withColumn("cell", cell("point")).join(touched, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "source")
    # Rank slots per source: counts by run of 65,536 slots, summed over runs, then ranks inside a run.
    dealt = materialize(dealt.withColumn("run", F.shiftright("slot", 16)), "mix-slots")
    missing = F.ceil(F.col("quota") / block) - F.coalesce("n", F.lit(0))
    has = dealt.groupBy(F.col("source").alias("__source")).agg(F.count("*").alias("n"))
    short = sources.join(has, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", missing.alias("more")).where("more > 0")
    last = F.sum("more").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    added = short.withColumn("last", last).select("source", "last", F.explode(F.sequence(F.lit(1), "more")).alias("i")).select((F.lit(slots) + F.col("last") - F.col("i")).alias("slot"), "source")
    dealt = materialize(dealt.select("slot", "source").unionByName(added).withColumn("run", F.shiftright("slot", 16)), "mix-slots")
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("source", "run").agg(F.count("*").alias("n")).select("source", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    ranked = inside.alias("i").join(runs.alias("r"), F.col("i.source").eqNullSafe(F.col("r.source")) & (F.col("i.run") == F.col("r.run")))
    schedule = ranked.select(F.col("i.slot").alias("slot"), F.col("i.source").alias("source"), (F.col("at") + F.col("base")).alias("turn"))
    return {"placed": placed, "sources": sources, "schedule": schedule, "block_words": block}


def pieces(mixed: dict) -> DataFrame:
    """The mix itself, a row for each part of a document that a slot takes: slot, doc_id, source, size, start,
    from_word, n_words, pass. Slots join the shuffled words of their source, which both sides cut into cells of a block's
    size; a document has a row a cell."""
    block = mixed["block_words"]
    words = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    p = mixed["placed"].where("size > 0").select("*", F.explode(words).alias("block")).alias("p")
    s, q = mixed["schedule"].alias("s"), mixed["sources"].alias("q")
    size = F.col("source_size")
    slot = s.join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).where("source_size > 0").select("slot", F.col("s.source").alias("source"), "source_size", (F.col("turn") * block).alias("from"), F.least((F.col("turn") + 1) * block, "quota").alias("upto")).where(F.col("from") < F.col("upto"))
    runs = slot.withColumn("pass", F.explode(F.sequence(F.floor(F.col("from") / size), F.floor((F.col("upto") - 1) / size))))
    runs = runs.select("slot", "source", "pass", F.greatest(F.col("from") - F.col("pass") * size, F.lit(0)).alias("from"), F.least(F.col("upto") - F.col("pass") * size, size).alias("upto"))
    t = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("upto") - 1) / block)))).alias("t")
    met = t.join(p, F.col("t.source").eqNullSafe(F.col("p.source")) & (F.col("t.block") == F.col("p.block")))
    lo = F.greatest(F.col("p.start"), F.col("t.block") * block, F.col("t.from"))
    hi = F.least(F.col("p.start") + F.col("p.size"), (F.col("t.block") + 1) * block, F.col("t.upto"))
    return met.select("slot", "p.doc_id", "p.source", "p.size", "p.start", (lo - F.col("p.start")).alias("from_word"), (hi - lo).alias("n_words"), "pass").where("n_words > 0")


def taken_words(mixed: dict) -> DataFrame:
    """Per row of placed: doc_id, size, source, source_size, target, taken (words, repeats counted; at most cap * size)."""
    keys = ["source", "start", "size", "doc_id"]
    took = pieces(mixed).groupBy(*keys).agg(F.sum("n_words").alias("taken"))
    d, t, q = mixed["placed"].alias("d"), took.alias("t"), mixed["sources"].alias("q")
    same = (F.col("d.size") > 0) & (F.col("d.start") == F.col("t.start"))
    for k in ("source", "size", "doc_id"):
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}"))
    full = d.join(t, same, "left").join(q, F.col("d.source").eqNullSafe(F.col("q.source")))
    return full.select("d.doc_id", "d.size", "d.source", "q.source_size", "q.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return taken_words(mix(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, text, source and more) with each row as often as the mix takes it, to the nearest whole number of
    times: a row that the mix takes for half of its words or less goes, and so do rows without a word. All columns are
    kept. A source's cut falls inside one document a pass, so whole documents come as near the target as that one."""
    md5 = F.md5(F.encode("text", "UTF-8"))
    slim = materialize(docs.select("doc_id", md5.alias("md5"), "source", word_count(F.col("text")).alias("size")), "mix-rows")
    took = taken_words(mix(slim.select(F.struct("doc_id", "md5").alias("doc_id"), "source", "size"), **how))
    times = took.where("size > 0").groupBy("doc_id", "source").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    own, copy, place, often, one = unused(docs, "own_id", "md5", "own_source", "times", "time")
    times = times.select(F.col("doc_id.doc_id").alias(own), F.col("doc_id.md5").alias(copy), F.col("source").alias(place), F.col("times").alias(often))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & md5.eqNullSafe(F.col(copy)) & F.col("source").eqNullSafe(F.col(place))
    return docs.join(times, same).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*docs.columns)
