"""Column expressions over text: cleaning, names, titles, tokens, classes of text blocks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Placeholders that stand for "nothing known", and words that carry no meaning in retrieval.
UNKNOWN = ("", "unknown", "none", "n/a", "null", "unk", "tbd")
UNKNOWN_NAMES = ("unknown", "unk", "n/a", "none", "tbd", "unknowns", "(unknown)", "?")
STOP_WORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for", "with", "by", "from", "is", "are", "was", "this", "that", "it")
# Quotation marks that make a text block dialogue, and the kana that mark a sound effect.
QUOTES = "「」『』“”„‟«»\""
SOUND_KANA = "ッっー"


def spaces(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elide(text: Column, unknown: tuple[str, ...] = UNKNOWN, limit: int | None = None) -> Column:
    """A cleaned value, or null for placeholders; over-long values end in an ellipsis."""
    clean = spaces(text)
    if limit:
        clean = F.when(F.char_length(clean) > limit, F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("…"))).otherwise(clean)
    return F.when(~F.lower(clean).isin(*unknown), clean)


def to_text(value: Column) -> Column:
    """A string, "unknown" for null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("unknown"))


def to_confidence(value: Column) -> Column:
    """A number clamped to 0 to 1; what is no number is 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def json_object(text: Column) -> Column:
    """The outermost {...} of a model's prose, or the text itself if it is one; null where no object parses."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    # Spark parses a text that goes on behind its first value; as the one element of an array, it may not.
    alone = F.try_parse_json(F.concat(F.lit("["), F.nullif(body, F.lit("")), F.lit("]")))
    return F.when(alone.isNotNull() & F.try_parse_json(body).isNotNull(), body)


def strip_answer(text: Column) -> Column:
    """A model's answer without a code fence, a leading label or quotes around it."""
    out = F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    out = F.regexp_replace(out, r"(?i)^(narration|narrator|output)\s*:\s*", "")
    return F.trim(F.regexp_replace(F.trim(out), r"^[\"'“”]+|[\"'“”]+$", ""))


#: Quotation marks that may stand around a name.
NAME_QUOTES = "\"'“”‘’「」『』"


def normalize_name(name: Column) -> Column:
    """A name's words without asides in parentheses, without the possessive ending of a word, and without quotes
    around the whole."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")), r"\s+")
    owned = F.transform(words, lambda w: F.regexp_replace(w, r"['’]s(?![A-Za-z0-9_])", ""))
    return F.trim(F.btrim(F.array_join(F.filter(owned, lambda w: w != ""), " "), F.lit(NAME_QUOTES)))


def is_unknown_name(name: Column) -> Column:
    low = F.lower(normalize_name(F.coalesce(name, F.lit(""))))
    return (low == "") | low.isin(*UNKNOWN_NAMES) | low.startswith("unknown")


def fuzzy_similar(a: Column, b: Column) -> Column:
    """Whether two names may be one person's: equal, one within the other (both of 6 letters or more), or the same
    first word of letters where either has more words."""
    return similar_forms(F.lower(normalize_name(a)), F.lower(normalize_name(b)))


def similar_forms(x: Column, y: Column) -> Column:
    """fuzzy_similar of names that are normalized and in lower case already."""
    first = lambda c: F.substring_index(c, " ", 1)
    inside = (F.char_length(x) >= 6) & (F.char_length(y) >= 6) & (x.contains(y) | y.contains(x))
    many = x.contains(" ") | y.contains(" ")
    same = many & (first(x) == first(y)) & first(x).rlike(r"^\p{L}+$")
    return F.coalesce((x != "") & (y != "") & ((x == y) | inside | same), F.lit(False))


def name_blocks(own: str, other: str):
    """Block keys of a name, of which two similar names share one if the two sides' marks are swapped: the first word, and
    the first six letters of a name among all runs of six letters of the other."""

    def keys(name: Column) -> Column:
        x = F.lower(normalize_name(name))
        n = F.char_length(x)
        runs = F.when(n >= 6, F.transform(F.sequence(F.lit(1), F.greatest(n - 5, F.lit(1))), lambda i: F.concat(F.lit(own + ":"), F.substring(x, i, F.lit(6)))))
        head = F.when(n >= 6, F.array(F.concat(F.lit(other + ":"), F.substring(x, F.lit(1), F.lit(6)))))
        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(F.array(F.concat(F.lit("first:"), F.substring_index(x, " ", 1))), F.coalesce(runs, none), F.coalesce(head, none)))

    return keys


def slug(text: Column, limit: int = 48, default: str = "item") -> Column:
    """Letters a-z and digits of a text in its compatible form, joined by single hyphens."""
    low = F.regexp_replace(F.regexp_replace(F.lower(compatible(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(low, 1, limit), F.lit("")), F.lit(default))


def title_key(text: Column) -> Column:
    """Lower-case letters and digits only, to compare titles."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")


# Words that begin a title's volume or chapter part, alone or with the number behind them, and words of
# packages in brackets.
VOLUME_WORDS = ("v", "vol", "volume", "ch", "chap", "chapter")
PACKAGE_WORDS = ("digital", "repack", "calibre", "scan", "cbz", "omnibus")


def strip_volume(text: Column) -> Column:
    """A title's words up to the first that names a volume or chapter, without a file ending, and without brackets at
    the end that hold a package's words or a year."""
    words = F.split(F.trim(F.regexp_replace(F.trim(text), r"\.[Pp][Dd][Ff]$", "")), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^a-z0-9]", ""))
    numbered = "^(?:" + "|".join(VOLUME_WORDS) + r")\d+$"
    marks = F.transform(bare, lambda w, i: F.when(w.rlike(numbered) | (w.isin(*VOLUME_WORDS) & F.coalesce(F.get(bare, i + 1), F.lit("")).rlike(r"^\d")), i))
    kept = F.array_join(F.slice(words, 1, F.coalesce(F.array_min(marks), F.size(words))), " ")
    holds = "|".join(PACKAGE_WORDS)
    return F.regexp_replace(F.regexp_replace(kept, rf"(?:\s*\((?:\d{{4}}|[^()]*(?i:{holds})[^()]*)\))+$", ""), r"[\s\-_,;:.!?(]+$", "")


def volume_number(text: Column) -> Column:
    """The first volume number of a title, or 0."""
    mark = F.regexp_extract(text, r"(?i)(?:^|[^A-Za-z0-9_])(?:v\.?\s*|vol(?:ume)?\.?\s*)(\d+)", 1)
    sign = F.regexp_extract(text, r"(?:^|[(\s,#-])#\s*(\d+)", 1)
    return F.coalesce(F.nullif(mark, F.lit("")).try_cast("int"), F.nullif(sign, F.lit("")).try_cast("int"), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters a-z and digits, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))), F.array(*(F.lit(w) for w in STOP_WORDS)))


# Words of a plan that say nothing, and the ranges of kana and of Chinese characters.
NOISE_WORDS = ("unknown", "none", "no", "undefined", "null")
EAST_ASIAN = "\u4e00-\u9fff\u3040-\u30ff"


def plan_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of a-z and digits that a plan is matched by: two characters or more, no noise."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1)))
    return F.filter(found, lambda w: (F.char_length(w) >= 2) & ~w.isin(*NOISE_WORDS))


def memory_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of a memory's text, in its compatible form: a-z, digits, kana and Chinese characters,
    without stop words. What else there is parts tokens."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(compatible(text)), F.lit(f"([a-z0-9{EAST_ASIAN}]+)"), F.lit(1)))
    return F.array_except(found, F.array(*(F.lit(w) for w in STOP_WORDS)))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which Spark has no function for; an Arrow batch at a time."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """A text in Unicode's compatible form (NFKC). Texts of ASCII alone are in it and are not sent to Python."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def block_class(text: Column) -> Column:
    """dialogue for text in quotes, sfx for short runs of sound kana or signs, else unknown."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.char_length(t)
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    sound = ~t.rlike(r"\s") & (n <= 8) & (t.rlike(f"[{SOUND_KANA}]") | (letters < 0.4 * n))
    return F.when(t == "", "unknown").when(t.rlike(f"[{QUOTES}]"), "dialogue").when(sound, "sfx").otherwise("unknown")


def entity_id(prefix: str, *parts: Column) -> Column:
    """A stable id: a prefix and eight hex digits of the md5 of the parts. Of some ten thousand such ids, two may be one."""
    return short_id(whole_id(prefix, *parts))


def whole_id(prefix: str, *parts: Column) -> Column:
    """A stable id that tables of any size are keyed by: a prefix and the whole md5 of the parts."""
    return F.concat(F.lit(prefix + "_"), F.md5(F.concat_ws(":", *parts)))


def short_id(id: Column) -> Column:
    """A whole id as it is shown: its prefix and eight digits."""
    return F.regexp_replace(id, "(_[0-9a-f]{8})[0-9a-f]{24}$", "$1")


def rate(text: Column) -> Column:
    """A rate written as a number or as "a/b"; null where b is 0 or either is no number."""
    part = F.split(text, "/")
    return F.try_divide(F.get(part, 0).try_cast("double"), F.coalesce(F.get(part, 1), F.lit("1")).try_cast("double"))


def speaker_seed(name: Column, n: int = 7) -> Column:
    """A small number that stands for a name: code points weighed by their places, modulo n."""
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name), F.lit(1))), lambda i: i * F.ascii(F.substring(name, i, F.lit(1))))
    return F.aggregate(letters, F.lit(0), lambda a, x: a + x) % n


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)
