"""Attribution by alias: where names stand in texts, whom a mention may be, and what is remembered of a person."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compatible, is_unknown_name, memory_tokens, normalize_name, similar_forms
from ..tables import drop, materialize, once
from .matching import top_k

#: Characters of a run by which aliases and texts meet.
RUN = 3


def runs(text: str, size: int) -> set[str]:
    """Distinct runs of so many characters."""
    return {text[i : i + size] for i in range(len(text) - size + 1)}


#: Up to so many runs of aliases go to every task, which then sends on only what it needs; beyond, texts' runs meet them in a join.
FEW_RUNS = 100_000


def _spread(rows: DataFrame, key: str, text: str, all_sizes: bool, wanted: frozenset[str] | None = None) -> DataFrame:
    """key and __run: the runs of texts, of one to RUN characters, or (not all_sizes) of RUN, or a shorter text itself; only those that are
    wanted, if given."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py() or ""
                found = list(set().union(*(runs(t, n) for n in range(1, RUN + 1))) if all_sizes else runs(t, min(RUN, len(t))))
                found = found if wanted is None else [r for r in found if r in wanted]
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(part), batch.schema.field(0).type), pa.array(part, pa.string())], names=[key, "__run"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, __run string")


#: Up to so many aliases are looked for one by one in each text, where it lies: for so few that costs less than a text's runs.
FEW_ALIASES = 2_000


def _looked_for(texts: DataFrame, id: str, text: str, names: list[str], alias: str) -> DataFrame:
    """id and alias, once a row of texts, for each of names that its text holds. Only pairs leave a task."""
    kind = texts.schema[id].dataType.simpleString()

    def run(batches):
        known = pa.array(names, pa.string())
        for batch in batches:
            said = batch.column(1).to_pylist()
            for at in range(0, len(said), 1_000):
                rows, found = [], []
                for i, t in enumerate(said[at : at + 1_000], at):
                    if t:
                        held = [n for n, name in enumerate(names) if name in t]
                        rows += [i] * len(held)
                        found += held
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), known.take(pa.array(found))], names=[id, alias])

    return texts.select(id, text).mapInArrow(run, f"`{id}` {kind}, `{alias}` string")


def mentions(texts: DataFrame, id: str, text: str, aliases: DataFrame, alias: str = "alias") -> DataFrame:
    """id and alias wherever a text holds an alias (distinct, not empty), both as they are: what contains() over all pairs
    gives. Null texts and aliases hold and are nothing.

    Few aliases go to every task and are looked for in each text as it is read; only rows whose id repeats are then made
    distinct. Many aliases and texts meet on runs of RUN characters (shorter aliases on themselves). Of its runs, an alias waits
    at the one that the fewest texts have, and only there is it looked for, so a run that all texts share brings no
    pairs unless an alias consists of such runs alone. Texts are not sent along: the ids that meet are joined back."""
    names = aliases.select(F.col(alias).alias("__alias")).where(F.length(F.col(alias)) > 0).distinct()
    few_names = names.limit(FEW_ALIASES + 1).collect()
    if len(few_names) <= FEW_ALIASES:
        single, again = once(texts, id)
        look = lambda df: _looked_for(df, id, text, [r["__alias"] for r in few_names], alias)
        return look(single) if again is None else look(single).unionByName(look(again).distinct())
    keyed = _spread(names.withColumn("text", F.col("__alias")), "__alias", "text", False)
    asked = materialize(keyed.select("__run").distinct(), "alias-asked")
    few = asked.limit(FEW_RUNS + 1).count() <= FEW_RUNS
    spread = _spread(texts, id, text, True, frozenset(r["__run"] for r in asked.collect()) if few else None)
    # Runs that no alias has are dropped before anything else is done with them.
    table = materialize(spread if few else spread.join(asked, "__run", "left_semi"), "alias-runs")
    frequency = table.groupBy("__run").agg(F.count("*").alias("__n"))
    # A run that no text has brings an alias nowhere, as it then has no text either.
    rare = keyed.join(frequency, "__run", "left").groupBy("__alias").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__run").alias("run"))).alias("__b"))
    waiting = rare.where("__b.n > 0").select("__alias", F.col("__b.run").alias("__run"))
    met = table.join(waiting, "__run").select(id, "__alias")
    found = materialize(met.join(texts.select(id, text), id).where(F.contains(F.col(text), F.col("__alias"))).select(id, F.col("__alias").alias(alias)).distinct(), "alias-mentions")
    drop(table, asked)
    return found


def identified(names: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """names (keys, name) with candidate and score: of the candidates (keys, place, candidate, description) of the same
    keys, the one that is the name (1.0), is like it (.7) or whose description holds it (.6); the best, then the first
    by place. Null for unknown names and where no candidate fits. Names are compared without endings, quotes and case.

    Texts are brought into the form in which they are compared before they meet, and distinct forms meet, not rows: of
    candidates alike in both texts, only the first by place can win. The pairs of a key are its distinct names times its
    distinct candidates, however often either repeats."""
    low = lambda c: F.lower(normalize_name(F.coalesce(c, F.lit(""))))
    asked = names.select(*keys, "name").distinct().where(~is_unknown_name(F.col("name"))).select(*keys, "name", low(F.col("name")).alias("__x"))
    forms = asked.select(*keys, "__x").distinct()
    first = candidates.groupBy(*keys, "candidate", "description").agg(F.min("place").alias("place"))
    known = first.groupBy(*keys, low(F.col("candidate")).alias("__y"), low(F.col("description")).alias("__d")).agg(F.max(F.struct((-F.col("place")).alias("p"), "candidate")).alias("__c"))
    x, y = F.col("__x"), F.col("__y")
    score = F.when(y == x, 1.0).when(similar_forms(x, y), 0.7).when((x != "") & F.contains(F.col("__d"), x), 0.6)
    met = forms.join(known, keys).withColumn("score", score).where("score IS NOT NULL")
    best = asked.join(met.groupBy(*keys, "__x").agg(F.max(F.struct("score", "__c")).alias("__b")), [*keys, "__x"]).select(*keys, "name", "__b")
    return names.join(best, [*keys, "name"], "left").select(*names.columns, F.col("__b.__c.candidate").alias("candidate"), F.col("__b.score").alias("score"))


def remembered_of(records: DataFrame, asked: DataFrame, aliases: DataFrame, limit: int = 6) -> DataFrame:
    """asked (name): the records (record, place, page, text) of which a token is the name, or the canonical name that
    aliases (alias, canonical) has for it: name, record, rank from 1, the latest page first, then those of no page, then
    by place. A name of several words is no token."""
    canon = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    known = asked.select("name").distinct().join(canon, F.col("name") == F.col("alias"), "left")
    spelt = known.select("name", F.explode(F.array_distinct(F.array_compact(F.array("name", "canonical")))).alias("__s"))
    wanted = spelt.select("name", F.trim(F.regexp_replace(F.lower(compatible(F.col("__s"))), "[^a-z0-9一-鿿぀-ヿ]+", " ")).alias("token")).where("token <> ''").distinct()
    said = records.select("record", "place", "page", F.explode(memory_tokens(F.col("text"))).alias("token"))
    met = said.join(wanted, "token").select("name", "record", "place", "page").distinct()
    return top_k(met, ["name"], [F.col("page").desc_nulls_last(), F.asc("place")], limit).drop("place")
