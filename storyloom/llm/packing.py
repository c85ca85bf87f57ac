"""Best-fit packing of tokenised documents by exact-complement hashing of lengths."""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, positions

CAPACITY = 2048
END_ID = 0


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Text -> numpy ids, as the tokenizer file gives them without special tokens.

    A byte-level BPE file whose ids follow its merges holds the same ranks that tiktoken takes, which encodes several
    times faster; any other file is run by tokenizers itself, and so is a text whose runs of white space are longer
    than the pattern engine of tiktoken can look back over. Strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    @functools.cache
    def slow() -> Tokenizer:
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        return made

    def ids(text: str) -> np.ndarray:
        return np.array(slow().encode(text, add_special_tokens=False).ids, dtype="<u4")

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges")
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if plain and isinstance(vocab, dict) and merges:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
            import public_tokenizers
            import tiktoken

            # The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow 256.
            itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
            stand = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in itself)}
            ranks = {bytes(stand[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
            fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def fast_ids(text: str) -> np.ndarray:
                try:
                    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
                except ValueError:  # the pattern ran out of stack
                    return ids(text)

            return fast_ids
    return ids


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text (null: empty). A document is its ids and END_ID; one longer than capacity is cut into pieces
    of capacity ids, the first of which takes the remainder. Returns doc_id, piece, start, length, ids_crc32, and
    ids (array<int>) if with_ids. One document at a time is in memory besides its Arrow batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([END_ID], dtype="<u4")).astype("<u4", copy=False)
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[a:b]
                    out.append((doc_id.as_py(), i, a, b - a, zlib.crc32(part.tobytes()), *([part.astype("<i4")] if with_ids else [])))
            columns = list(zip(*out)) or [[] for _ in range(5 + with_ids)]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences to make of counts (pieces by length, each under capacity): (lengths side by side, how often).

    Longest first, the gap beside a length is looked up among single lengths, then sums of two, then sums of three
    that are still available, and an exact filling is consumed as often as all its counts allow, so each step ends
    a length. Every single length, pair and triple of a gap is tried before it counts as having no exact filling. What
    no exact filling takes is packed best-fit: the longest that fits, again and again. Input and output are bounded by
    capacity, not by the data."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    size = 1 << (2 * capacity).bit_length()

    def pair_sums() -> np.ndarray:
        """For each sum, in how many ways two available lengths make it."""
        return np.rint(np.fft.irfft(np.fft.rfft((have > 0).astype(float), size) ** 2, size))[: capacity + 1]

    def times(parts: tuple[int, ...]) -> int:
        return min(int(have[x]) // k for x, k in Counter(parts).items())

    def pair(head: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(have[a] > 0) & (have[gap - a] > 0)]:
            if times(found := (*head, int(x), gap - int(x))):
                return found
        return None

    def exact(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if have[gap] and times((length, gap)):
            return (length, gap)
        if found := pair((length,), gap):
            return found
        if gap < 3:
            return None
        c, sums = np.arange(gap - 2, 0, -1), pair_sums()
        for x in c[(have[c] > 0) & (sums[gap - c] > 0)]:
            if times((length, int(x))) and (found := pair((length, int(x)), gap - int(x))):
                return found
        return None

    def use(parts: tuple[int, ...]) -> None:
        n = times(parts)
        for x in parts:
            have[x] -= n
        out.append((parts, n))

    for length in range(capacity, 0, -1):
        while have[length] > 0:
            parts = (length,) if length == capacity else exact(length)
            if parts is None:
                break
            use(parts)
    for length in range(capacity, 0, -1):
        while have[length] > 0:
            parts, gap, left = [length], capacity - length, have.copy()
            left[length] -= 1
            while gap > 0 and len(fits := np.flatnonzero(left[1 : gap + 1])):
                parts.append(int(fits[-1]) + 1)
                left[parts[-1]] -= 1
                gap -= parts[-1]
            use(tuple(parts))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces: a written table with doc_id, piece, length (1 to capacity) and more. Adds sequence_id and offset.

    Only the histogram of lengths, at most capacity rows, reaches the driver; the plan made of it gives each length
    ranges of ranks, also bounded by capacity, which the pieces join by their rank within their length. Ranks come
    from two-level counts, so one length may hold any share of the rows. Repeated pieces are packed one by one."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made, used, base, rows = plan(counts, capacity), Counter(), 0, []
    for parts, n in made:
        offset = 0
        for x in parts:
            rows.append((x, used[x], used[x] + n, base - used[x], offset))
            used[x] += n
            offset += x
        base += n
    ranges = pieces.sparkSession.createDataFrame(rows, "r_length long, lo long, hi long, shift long, r_offset long")
    ranked = positions(pieces, ["length"], ["doc_id", "piece"], {"__rank": F.lit(1)}, sum(counts.values()))
    met = (F.col("length") == F.col("r_length")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi"))
    joined = ranked.join(F.broadcast(ranges), met)
    return joined.select(*pieces.columns, (F.col("__rank") + F.col("shift")).alias("sequence_id"), F.col("r_offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """packed with ids: one row a sequence, its pieces' ids side by side (at most capacity of them)."""
    put = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(put, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. Returns a row a piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Null and empty texts are one piece of END_ID; repeated rows are packed one by one; pieces of
    one length are ranked by a hash, ties arbitrarily; an empty table gives no rows."""
    pieces = materialize(cut(docs, path or tokenizer_path(), capacity, with_ids), "pieces")
    return pack(pieces, capacity)


def op2_pack_documents(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
