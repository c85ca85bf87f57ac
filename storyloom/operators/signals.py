"""Sampled signals in blocks: a row holds the samples of a key from place `at` on, so a signal of any length is many rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least amplitude that has a level, the level under which a signal is silent, the most that an effect
# may have of the narration's peak, and the seconds over which an effect is faded.
LEAST = 1e-9
SILENT = 0.005
BELOW = 0.5
FADE = 0.02

#: Samples of a block of silence.
PIECE = 4_096


def lengths(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n, the samples of each signal."""
    return blocks.groupBy(*keys).agg(F.max(F.col("at") + F.size("samples")).cast("long").alias("n"))


def resampled_length(n: Column, rate: Column, to: Column) -> Column:
    return F.when(rate == to, n).otherwise(F.bround(n * to.cast("double") / rate.cast("double")).cast("long"))


def resampled(blocks: DataFrame, keys: list[str], rate: Column, to: Column) -> DataFrame:
    """blocks (keys, at, samples: doubles; gapless) at a rate, both positive, at another one, by linear interpolation
    from the first sample to the last. A signal's length changes in proportion, rounded half to even; of no length
    it has no rows. Blocks that come out are as their sources cut them."""
    return _by_block(_with_next(blocks, keys, rate, to), keys, lambda c: _reach(c, c["m"])[1], lambda c, values, first: _between(c, values, first, c["m"]))


def _with_next(blocks: DataFrame, keys: list[str], rate: Column, to: Column, beside: DataFrame | None = None) -> DataFrame:
    """What _between needs of each block, behind keys, and the columns of beside (keys: one row each), where it is given. A new sample lies
    between two old ones, which may be the last of a block and the first of the next: each block is sent the first sample of
    its neighbour, by a join on the place where it ends, so no task holds a signal."""
    slim = blocks.select(*keys, "at", F.size("samples").alias("__size"), F.get("samples", F.lit(0)).alias("__first"), rate.cast("double").alias("__rate"), to.cast("double").alias("__to")).where("__size > 0")
    whole = slim.groupBy(*keys).agg(F.max(F.col("at") + F.col("__size")).cast("long").alias("n"))
    sized = _scaled(slim.drop("__first").join(whole, keys), F.col("__rate"), F.col("__to")).withColumn("__end", F.col("at") + F.col("__size"))
    halo = slim.select(*keys, F.col("at").alias("__end"), F.col("__first").alias("__next"))
    facts = sized.join(halo, [*keys, "__end"], "left").select(*keys, "at", "__end", "n", "m", "step", "__next")
    if beside is not None:
        facts = facts.join(beside, keys)
    # Facts are worked out on slim rows; the samples themselves are moved once.
    joined = blocks.where(F.size("samples") > 0).select(*keys, "at", "samples").join(facts, [*keys, "at"])
    known = F.when(F.col("__next").isNull(), F.col("samples")).otherwise(F.array_append("samples", F.col("__next")))
    return joined.withColumn("samples", known).withColumnRenamed("at", "__begin").drop("__next")


def _scaled(signals: DataFrame, rate: Column, to: Column) -> DataFrame:
    """signals (n samples each) with m, their length at another rate, and step, the old samples from a new one to the next; those of no
    length are left out."""
    sized = signals.withColumn("m", resampled_length(F.col("n"), rate.cast("double"), to.cast("double"))).where("m > 0")
    return sized.withColumn("step", F.when((F.col("m") > 1) & (F.col("n") > 1), (F.col("n") - 1) / (F.col("m") - 1).cast("double")).otherwise(0.0))


def _reach(c: dict, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first new sample that may lie in each block, and how many from it on, of those numbered under most: about __begin / step to
    __end / step."""
    step = np.where(c["step"] > 0, c["step"], 1.0)
    low = np.where(c["step"] > 0, np.maximum(0, (c["__begin"] / step).astype(np.int64) - 1), 0)
    last = np.where(c["step"] > 0, np.minimum(c["m"] - 1, np.ceil(c["__end"] / step).astype(np.int64) + 1), c["m"] - 1)
    return low, np.maximum(0, np.minimum(last, most - 1) - low + 1)


def _between(c: dict, values: np.ndarray, first: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and value of the new samples, numbered under most, whose old place is in [__begin, __end) of a row of c; the place itself
    decides. A row's old samples begin at first in values and end where those of the next row begin."""
    low, counts = _reach(c, most)
    row = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts - low, counts)
    place = k * c["step"][row]
    end = (k == c["m"][row] - 1) & (c["step"][row] > 0)
    place[end] = c["n"][row[end]] - 1
    whole = np.floor(place).astype(np.int64)
    mine = (whole >= c["__begin"][row]) & (whole < c["__end"][row])
    row, k, place, whole = row[mine], k[mine], place[mine], whole[mine]
    i, last = whole - c["__begin"][row], np.append(first[1:], len(values)) - 1
    a, b = values[first[row] + i], values[np.minimum(first[row] + i + 1, last[row])]
    return row, k, (b - a) * (place - whole) + a


def _ramped(samples: np.ndarray, place: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Samples at places of signals of n samples, faded in over a samples and out over b."""
    out = samples.copy()
    up, down = np.flatnonzero((a > 1) & (place < a)), np.flatnonzero((b > 1) & (place >= n - b))
    out[up] *= place[up] / (a[up] - 1)
    out[down] *= 1.0 - (place[down] - (n[down] - b[down])) / (b[down] - 1)
    return out


#: New samples that are worked on at once.
LOT = 1 << 19


def _by_block(rows: DataFrame, keys: list[str], counts, made) -> DataFrame:
    """keys, at, samples: made(c, values, first) gives the row, place and value of every sample that comes of the rows of c, which has the
    columns behind the keys as numpy arrays; values are the samples of these rows, if they have any, and first where those of each
    begin. Each row's samples follow each other; rows that give none are left out. Rows go together as long as they
    have at most LOT samples to give by counts(c), as what a row gives may be longer than the row."""
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [x for x in rows.columns if x not in keys and x != "samples"]

    def run(batches):
        for batch in batches:
            given = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
            ends, begin = np.cumsum(counts(given)), 0
            while begin < len(ends):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LOT, "right")))
                part, values, first = batch.slice(begin, end - begin), np.zeros(0), np.zeros(end - begin, np.int64)
                if "samples" in part.schema.names:
                    arrays = part.column("samples")
                    values, sizes = arrays.flatten().to_numpy(zero_copy_only=False), arrays.value_lengths().to_numpy(zero_copy_only=False)
                    first = np.cumsum(sizes, dtype=np.int64) - sizes
                row, place, out = made({x: v[begin:end] for x, v in given.items()}, values, first)
                begin = end
                if not len(row):
                    continue
                sizes = np.bincount(row, minlength=part.num_rows)
                picked = np.flatnonzero(sizes)
                ends_here = np.cumsum(sizes[picked])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends_here)), pa.int32()), pa.array(out, pa.float64()))
                at = pa.array(place[ends_here - sizes[picked]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(picked)) for k in keys), at, lists], names=[*keys, "at", "samples"])

    return rows.mapInArrow(run, f"{kind}, at long, samples array<double>")


def drawn(places: DataFrame, keys: list[str], count: str, value, of: list[str]) -> DataFrame:
    """places (keys, at, count, and the columns of) with samples: value(numbers, *of) gives those numbered at, at + 1 and so on, count of
    them, as numpy arrays over all samples of an Arrow batch at once. Places of no samples are left out."""
    rows = places.where(F.col(count) > 0).select(*keys, F.col("at").cast("long").alias("at"), F.col(count).cast("long").alias("__n"), *(F.col(c).alias(f"__of{i}") for i, c in enumerate(of)))
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            at, counts, *given = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys), batch.num_columns))
            ends = np.cumsum(counts)
            numbers = np.arange(counts.sum()) + np.repeat(at - (ends - counts), counts)
            samples = value(numbers, *(np.repeat(c, counts) for c in given))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(samples, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys) + 1)), lists], names=[*keys, "at", "samples"])

    return rows.mapInArrow(run, f"{kind}, at long, samples array<double>")


def faded(blocks: DataFrame, keys: list[str], rate: Column, fade_in: Column, fade_out: Column) -> DataFrame:
    """Blocks with their signal faded in and out, linearly over so many seconds; fades are cut to its length, and one of a
    sample or none does nothing."""
    whole = blocks.join(lengths(blocks, keys), keys)
    counts = (_fade(F.col("n"), rate, f).alias(name) for f, name in ((fade_in, "__a"), (fade_out, "__b")))

    def made(c, values, first):
        row = np.repeat(np.arange(len(first)), c["__size"])
        place = np.arange(len(row)) - first[row] + c["at"][row]
        return row, place, _ramped(values, place, *(c[x][row] for x in ("n", "__a", "__b")))

    rows = whole.where(F.size("samples") > 0).select(*keys, "samples", "at", "n", F.size("samples").alias("__size"), *counts)
    return _by_block(rows, keys, lambda c: c["__size"], made)


def _fade(n: Column, rate: Column, seconds: Column) -> Column:
    return F.least(F.greatest(F.bround(seconds * rate), F.lit(0)).cast("long"), n)


def fitted(blocks: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """Blocks of a signal cut to its first n samples, or followed by silence up to n, in blocks too; n null or 0 leaves it."""
    wanted = blocks.groupBy(*keys).agg(F.max(F.col("at") + F.size("samples")).alias("__have"), F.max(F.coalesce(n.cast("long"), F.lit(0))).alias("__n"))
    cut = blocks.select(*keys, "at", "samples").join(wanted, keys).where("size(samples) > 0 AND (__n = 0 OR at < __n)")
    kept = F.when((F.col("__n") > 0) & (F.col("at") + F.size("samples") > F.col("__n")), F.slice("samples", F.lit(1), (F.col("__n") - F.col("at")).cast("int"))).otherwise(F.col("samples"))
    rest = _silence(wanted, F.col("__have"), F.col("__n")).select(*keys, "at", "samples")
    return cut.select(*keys, "at", kept.alias("samples")).unionByName(rest)


def _silence(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows with blocks (at, samples) of silence from a place up to another one, where that lies behind it."""
    spans = rows.select("*", start.cast("long").alias("__from"), end.cast("long").alias("__until")).where("__until > __from")
    cut = spans.withColumn("at", F.explode(F.sequence(F.col("__from"), F.col("__until") - 1, F.lit(PIECE).cast("long"))))
    return cut.withColumn("samples", F.array_repeat(F.lit(0.0), F.least(F.lit(PIECE), F.col("__until") - F.col("at")).cast("int")))


def overlap_add(pieces: DataFrame, keys: list[str], size: int = 4_096, level: str | None = None) -> DataFrame:
    """pieces (keys, at, samples) that lie anywhere, each times its level if that column is named, summed where they overlap: keys, at
    (multiples of size), samples (size of them, 0 where no piece is), a row for each block that a piece touches. Places
    before 0 are cut off.

    A piece is cut at the blocks' borders by the task that has it, and added to what the task has of a block before anything
    is moved, so a block that every piece touches is sent once a task; then the tasks' sums of a block are added as they
    stream by."""
    flat = pieces.select(*keys, F.col("at").cast("long").alias("__at"), F.col("samples").cast("array<double>").alias("samples"), (F.lit(1.0) if level is None else F.col(level).cast("double")).alias("__level"))
    kind = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys)

    def add(batches, room: int):
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def given():
            rows = list(held.items())
            held.clear()
            columns = [pa.array([k[i] for k, _ in rows], schema.field(i).type) for i in range(len(keys))]
            places = pa.array([k[-1] * size for k, _ in rows], pa.int64())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(np.concatenate([v for _, v in rows])))
            return pa.RecordBatch.from_arrays([*columns, places, values, pa.array([1.0] * len(rows))], names=[*keys, "__at", "samples", "__level"])

        for batch in batches:
            schema = batch.schema
            *key, at, arrays, levels = (batch.column(i) for i in range(batch.num_columns))
            # Null samples are none; a piece without a place lies nowhere.
            counts = np.where(at.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(arrays.value_lengths(), 0).to_numpy(zero_copy_only=False), 0)
            values, ends = arrays.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(arrays.value_lengths(), 0).to_numpy(zero_copy_only=False))
            if level is not None:
                values = values * np.repeat(levels.to_numpy(zero_copy_only=False).astype(float), np.diff(ends, prepend=0))
            begins, ends = (ends - counts).tolist(), ends.tolist()
            for name, place, begin, end in zip(zip(*(c.to_pylist() for c in key)), at.to_pylist(), begins, ends):
                if begin == end:
                    continue
                if place < 0:
                    begin, place = begin - place, 0
                while begin < end:
                    b, o = divmod(place, size)
                    n = min(end - begin, size - o)
                    block = held.get((*name, b))
                    if block is None:
                        if len(held) >= room:
                            yield given()
                        block = held[(*name, b)] = np.zeros(size)
                    block[o : o + n] += values[begin : begin + n]
                    begin, place = begin + n, place + n
        if held:
            yield given()

    schema = f"{kind}, __at long, samples array<double>, __level double"
    summed = flat.mapInArrow(lambda batches: add(batches, 512), schema)
    dealt = summed.repartition(*keys, "__at").sortWithinPartitions(*keys, "__at")
    # Sorted, so a block's sums follow each other, and one block is held at a time.
    return dealt.mapInArrow(lambda batches: add(batches, 1), schema).select(*keys, F.col("__at").alias("at"), "samples")


def levels(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, peak, peak_db (of the peak, at least LEAST), rms and silent, over all blocks of a signal."""
    square = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)
    peak = F.coalesce(F.array_max(F.transform("samples", F.abs)), F.lit(0.0))
    out = blocks.groupBy(*keys).agg(F.sum(F.size("samples")).alias("n"), F.max(peak).alias("peak"), F.sum(square).alias("__s"))
    rms = F.sqrt(F.try_divide(F.col("__s"), F.col("n")))
    return out.select(*keys, "n", "peak", peak_db(F.col("peak")).alias("peak_db"), F.coalesce(rms, F.lit(0.0)).alias("rms"), (F.coalesce(rms, F.lit(0.0)) < SILENT).alias("silent"))


def peak_db(peak: Column) -> Column:
    return 20.0 * F.log10(F.greatest(peak.cast("double"), F.lit(LEAST)))


def limited(level: Column, narration_peak: Column, cap: Column) -> Column:
    """An effect's level: at most the cap, and at most a share of the narration's peak where there is one."""
    ceiling = F.when(narration_peak > 0, F.least(cap, BELOW * narration_peak)).otherwise(cap)
    return F.least(level, F.greatest(ceiling, F.lit(0.0)))


def event_start(start: Column, offset: Column, segment_start: Column) -> Column:
    """When an effect sounds: at its own start, else at its offset behind its segment's (0 for an unknown segment)."""
    return F.coalesce(start.cast("double"), F.coalesce(segment_start.cast("double"), F.lit(0.0)) + F.coalesce(offset.cast("double"), F.lit(0.0)))


def effects(events: DataFrame, blocks: DataFrame, id: str, rate: int, narration_peak: Column, cap: Column, keep: list[str] = ()) -> DataFrame:
    """events (id: one row each, start_time, offset, segment_start, volume, duration, and columns to keep) with the sound of each (blocks:
    id, rate, at, samples): resampled, cut or padded to its duration, faded, at its level, and moved to its place: id,
    keep, at, samples. What an event asks for goes to its blocks first, so they are made, cut and faded in one pass."""
    asked = events.select(id, *keep, *_asked(rate, narration_peak, cap))
    sound = _by_block(_with_next(blocks, [id], F.col("rate"), F.lit(rate), asked), [id, *keep], lambda c: _reach(c, _whole(c))[1], lambda c, values, first: _sounded(c, values, first, rate))
    sizes = blocks.groupBy(id).agg(F.max(F.col("at") + F.size("samples")).cast("long").alias("n"), F.max("rate").alias("__rate")).where("n > 0")
    return sound.unionByName(_padded(_scaled(sizes.join(asked, id), F.col("__rate"), F.lit(rate)), [id, *keep]))


def drawn_effects(events: DataFrame, keys: list[str], rate: int, narration_peak: Column, cap: Column, cut: int, value, of: list[str]) -> DataFrame:
    """As effects, for events that say of their sound how many samples it has (n) and at what rate, and whose samples are drawn as in drawn:
    keys, at, samples. Keys may repeat: each row is an event. A task draws the sound of its own events, in blocks of cut and
    each with the first sample of the next, so no samples are written or moved."""
    asked = events.select(*keys, F.col("n").cast("long").alias("n"), F.col("rate").alias("__rate"), *_asked(rate, narration_peak, cap), *(F.col(c).alias(f"__of{i}") for i, c in enumerate(of)))
    known = _scaled(asked.where("n > 0"), F.col("__rate"), F.lit(rate)).drop("__rate")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(cut).cast("long")))
    blocks = known.withColumn("__begin", begin).withColumn("__end", F.least(F.col("__begin") + cut, F.col("n")))

    def made(c, *_):
        counts = np.minimum(c["__end"] + 1, c["n"]) - c["__begin"]
        first = np.cumsum(counts) - counts
        numbers = np.arange(counts.sum()) + np.repeat(c["__begin"] - first, counts)
        values = value(numbers, *(np.repeat(c[f"__of{i}"], counts) for i in range(len(of))))
        return _sounded(c, values, first, rate)

    # A block may have many samples that give few new ones.
    sound = _by_block(blocks, keys, lambda c: np.maximum(_reach(c, _whole(c))[1], c["__end"] - c["__begin"]), made)
    return sound.unionByName(_padded(known, keys))


def _asked(rate: int, narration_peak: Column, cap: Column) -> list[Column]:
    """What an event asks of its sound: the samples wanted (0: as many as there are), the level and the first place."""
    level = F.when(F.col("volume") > 0, limited(F.col("volume"), narration_peak, cap)).otherwise(0.0).cast("double")
    start = F.bround(event_start(F.col("start_time"), F.col("offset"), F.col("segment_start")) * rate).cast("long")
    want = F.greatest(F.coalesce(F.bround(F.col("duration") * rate).cast("long"), F.lit(0)), F.lit(0))
    return [want.alias("__want"), level.alias("__level"), start.alias("__start")]


def _whole(c: dict) -> np.ndarray:
    return np.where(c["__want"] > 0, c["__want"], c["m"])


def _sounded(c: dict, values: np.ndarray, first: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of the samples of effects, of blocks as _between takes them: resampled, cut, faded, at their level and place."""
    n = _whole(c)
    row, k, out = _between(c, values, first, n)
    fade = np.minimum(round(FADE * rate), n)
    return row, k + c["__start"][row], _ramped(out, k, n[row], fade[row], fade[row]) * c["__level"][row]


def _padded(events: DataFrame, keys: list[str]) -> DataFrame:
    """The silence behind sounds that are shorter than wanted."""
    return _silence(events.where("__want > m"), F.col("__start") + F.col("m"), F.col("__start") + F.col("__want")).select(*keys, "at", "samples")
