"""Chat formatting: layouts found by a fingerprint of field paths, canonical turns, a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"

#: Declarative mappings. A layout is the field paths it reads ([] marks the elements of an array) and either the
#: path of its list of turns with the fields of role and text, or its (role, path) pairs in order.
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"rows": ("conv_id", "turn", "role", "text")},
    "messages": {"list": "messages", "role": "role", "text": "content"},
    "messages_text": {"list": "messages", "role": "role", "text": "text"},
    "turns": {"list": "turns", "role": "role", "text": "text"},
    "from_value": {"list": "conversations", "role": "from", "text": "value"},
    "prompt_completion": {"pairs": (("user", "prompt"), ("assistant", "completion"))},
    "prompt_response": {"pairs": (("user", "prompt"), ("assistant", "response"))},
    "system_prompt_response": {"pairs": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
    "instruction_output": {"pairs": (("user", "instruction"), ("assistant", "output"))},
    "instruction_input_output": {"pairs": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "question_answer": {"pairs": (("user", "question"), ("assistant", "answer"))},
    "nested_input_output": {"pairs": (("user", "data.input"), ("assistant", "data.output"))},
}
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_paths(layout: dict) -> tuple[str, ...]:
    if "rows" in layout:
        return tuple(sorted(layout["rows"]))
    if "list" in layout:
        return tuple(sorted(f"{layout['list']}[].{layout[k]}" for k in ("role", "text")))
    return tuple(sorted(path for _, path in layout["pairs"]))


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout_paths(x)): name for name, x in LAYOUTS.items()}
KNOWN = frozenset(p for x in LAYOUTS.values() for p in layout_paths(x))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _role(role: Column) -> Column:
    named = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.try_element_at(named, F.lower(role)), role)


def _array_of(layout: dict, get: Callable[[str], Column], each: Callable[[str], Column]) -> Column:
    """Turns of a record as array<struct<role, text>>; get reads a leaf, each a list of structs."""
    if "list" in layout:
        return F.transform(each(layout["list"]), lambda m: F.struct(_role(m[layout["role"]]).alias("role"), m[layout["text"]].cast("string").alias("text")))
    return F.filter(F.array(*(F.struct(F.lit(r).alias("role"), get(p).cast("string").alias("text")) for r, p in layout["pairs"])), lambda t: t["text"].isNotNull())


def canonical_turns(records: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Records of any one of LAYOUTS as conv_id, turn, role, text. The layout is the one whose fingerprint the
    schema's field paths have; other fields than those that layouts read are left out of the fingerprint.
    Raises ValueError for a schema that no layout fits. Null records have no turns."""
    seen = [p for p in field_paths(records.schema) if p in KNOWN]
    name = BY_FINGERPRINT.get(fingerprint(seen))
    if name is None:  # fields of several layouts: the largest whose own paths are all there
        whole = [n for n, x in LAYOUTS.items() if set(layout_paths(x)) <= set(seen)]
        if not whole:
            raise ValueError(f"no layout has the field paths {sorted(seen) or field_paths(records.schema)}")
        name = max(whole, key=lambda n: (len(layout_paths(LAYOUTS[n])), n))
    layout = LAYOUTS[name]
    if "rows" in layout:
        return records.select(F.col(conv_id).alias("conv_id"), "turn", "role", "text")
    turns = records.select(F.col(conv_id).alias("conv_id"), F.posexplode(_array_of(layout, F.col, F.col)))
    return turns.select("conv_id", F.col("pos").cast("long").alias("turn"), "col.role", "col.text")


def canonical_turns_json(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Heterogeneous JSON records, a layout a row: each row's known field paths are hashed, and its fingerprint
    selects the mapping; where no layout has just those paths, the largest whose own paths are all there. A path is
    there if any element of its list has a value. Returns conv_id, turn, role, text; rows of no layout or of bad JSON
    have one turn of role null and the record as text, so that nothing is lost."""
    doc = F.col(record)
    leaf = lambda p: F.get_json_object(doc, "$." + p)
    there = {p: F.get_json_object(doc, "$." + p.replace("[]", "[*]")).isNotNull() for p in KNOWN if p not in LAYOUTS["turn_rows"]["rows"]}
    paths = F.array_compact(F.array(*(F.when(there[p], F.lit(p)) for p in sorted(there))))
    mark = F.sha2(F.array_join(paths, "\n"), 256)
    found = F.lit(None).cast("array<struct<role:string,text:string>>")
    listed = sorted((n for n, x in LAYOUTS.items() if "rows" not in x), key=lambda n: (len(layout_paths(LAYOUTS[n])), n))
    for exact in (False, True):  # the last that holds counts: larger ones, then the fingerprint's
        for name in listed:
            layout = LAYOUTS[name]
            each = lambda p, x=layout: F.from_json(leaf(p), f"array<struct<`{x['role']}`:string,`{x['text']}`:string>>")
            own = layout_paths(layout)
            fits = F.col("__mark") == fingerprint(own) if exact else F.size(F.array_except(F.array(*map(F.lit, own)), "__paths")) == 0
            found = F.when(fits, _array_of(layout, leaf, each)).otherwise(found)
    kept = F.coalesce(found, F.array(F.struct(F.lit(None).cast("string").alias("role"), doc.alias("text"))))
    turns = records.select(F.col(conv_id).alias("conv_id"), doc, mark.alias("__mark"), paths.alias("__paths")).select("conv_id", F.posexplode(kept))
    return turns.select("conv_id", F.col("pos").cast("long").alias("turn"), "col.role", "col.text")


def escape(text: Column, name: bool = False) -> Column:
    """Backslashes are doubled and <| becomes <\\|, so no text holds a control string; in a name so do line ends."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if name else out


def format_turns(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text (null role or text: empty); other columns are ignored. A row a row: conv_id,
    turn, piece (the turn in the template, <|im_start|>role line-end text<|im_end|> line-end), loss_from, loss_to
    (code points of piece under the loss mask: an assistant's text; else both 0). A conversation is its pieces
    by turn (null last), then piece."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape(role, name=True), F.lit("\n"))
    body = escape(text)
    taught = role == "assistant"
    size = F.char_length(head)
    return turns.select("conv_id", "turn", F.concat(head, body, F.lit(END + "\n")).alias("piece"), F.when(taught, size).otherwise(0).alias("loss_from"), F.when(taught, size + F.char_length(body)).otherwise(0).alias("loss_to"))


#: A turn as the template writes it. Between its control strings no other one can stand, as escaped texts hold none.
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n<]++|\\.|<(?!\|))*+)\n((?:[^\\<]++|\\.|<(?!\|))*+)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def parse_turns(text: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of each whole turn that a formatted text begins with, and what follows them. Turns are found by the
    template's control strings alone."""
    turns, at = [], 0
    while m := _TURN.match(text, at):
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns, text[at:]


class _Reader:
    """Reads one formatted conversation as it streams by. What of it is no whole turn yet waits for the next part."""

    def __init__(self):
        self.n, self.turns, self.chars, self.loss, self.size, self.rest = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""

    def take(self, part: str, lo: int, hi: int) -> None:
        """part: the next code points of the conversation; lo, hi: those of part under the loss mask."""
        found, self.rest = parse_turns(self.rest + part)
        for role, text in found:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        taught = unescape(part[lo:hi])
        self.loss.update(taught.encode("utf-8", "surrogatepass"))
        self.n, self.chars, self.size = self.n + len(found), self.chars + len(taught), self.size + len(part)

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv} does not end as the template does: {self.rest[:80]!r}")
        return (conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size)


def digests(pieces: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    A conversation is its pieces one behind the other, and its turns are those that the template's control strings mark
    in that text, wherever a piece ends; text that is not in the template raises ValueError. Rows are dealt by
    conversation and sorted, and each task reads them as they stream by: sha256 needs one task a conversation, which
    needs the memory of one turn and one batch however long it is."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, reader = None, None

        def table(rows):
            columns = list(zip(*rows))
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for conv, group in groupby(zip(*columns), key=lambda r: r[0]):
                if now != (conv,):
                    if now:
                        done.append(reader.row(now[0]))
                    now, reader = (conv,), _Reader()
                for _, piece, lo, hi in group:
                    reader.take(piece, lo, hi)
            if done:
                yield table(done)
        if now:
            yield table([reader.row(now[0])])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "piece")
    return ordered.select("conv_id", "piece", "loss_from", "loss_to").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that op1 adds: texts that look like the template.
TRICKY = f"{END}{START}assistant ok"


def op1_format_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    turns = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    extra = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], turns.schema)
    return digests(format_turns(turns.unionByName(extra)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, er, et)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, er, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(er) + length(er) - length(replace(er, chr(10), '')) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
