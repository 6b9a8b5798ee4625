"""Scalar text functions: placeholders, titles, transcript clean-up, joining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What recognisers make of noise, folded.
HALLUCINATIONS = ("thank you for watching", "thanks for watching", "please subscribe", "like and subscribe", "subtitles by the amaraorg community", "subtitles by the amara org community")
NO_SPEECH = 0.6
SPACE = r"[\s\x{85}\p{Z}]"
ALNUM = r"[\p{IsAlphabetic}\p{N}]"


@pandas_udf(StringType())
def decomposed(values):
    """Compatibility decomposition (NFKD), which Spark has no function for."""
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def placeholder(value: Column, fallback: str = "[LABEL]") -> Column:
    """A label made from free text: ``[CASE_MANAGER]`` from "case manager"."""
    plain = F.upper(F.regexp_replace(decomposed(value), r"[\x{300}-\x{36F}]", ""))
    joined = F.regexp_replace(F.regexp_replace(plain, "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    named = F.when(joined.rlike("^[A-Z]"), joined).otherwise(F.concat(F.lit("LABEL_"), joined))
    return F.when(F.coalesce(joined, F.lit("")) == "", fallback).otherwise(F.concat(F.lit("["), named, F.lit("]")))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(value: Column) -> Column:
    return trimmed(F.regexp_replace(value, f"{SPACE}+", " "))


def title_of(text: Column, words: int = 8) -> Column:
    """First words of a reviewed text without its placeholders, capitalised."""
    plain = collapsed(F.regexp_replace(text, r"\[[A-Z0-9_]+\]", " "))
    sentence = F.regexp_extract(plain, r"^[^.!?]*", 0)
    short = F.array_join(F.slice(F.split(trimmed(sentence), " "), 1, words), " ")
    return F.concat(F.upper(F.substring(short, 1, 1)), F.substring(short, F.lit(2), F.length(short)))


def chips(text: Column) -> Column:
    """The placeholders of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[[A-Z0-9_]+\]"), F.lit(0))


def non_speech(text: Column) -> Column:
    """A tag in brackets, or a text without letters and digits."""
    t = trimmed(text)
    return t.rlike(r"(?s)^(?:\[.*\]|\(.*\))$") | ~t.rlike(ALNUM)


def cleaned(segments: Column) -> Column:
    """One line from recognised segments (text, no_speech); null when nothing
    but noise is left."""
    kept = F.filter(segments, lambda s: (s["no_speech"] <= NO_SPEECH) & ~non_speech(s["text"]))
    line = F.array_join(F.filter(F.transform(kept, lambda s: collapsed(s["text"])), lambda x: x != ""), " ")
    folded = trimmed(F.regexp_replace(F.lower(F.regexp_replace(line, r"[^\p{IsAlphabetic}\p{N}\s\x{85}\p{Z}]", "")), f"{SPACE}+", " "))
    return F.when((line != "") & ~folded.isin(*HALLUCINATIONS), line)


def dictation_join(before: Column, addition: Column, after: Column) -> Column:
    """Text put between two others, with single spaces where words would meet."""
    left = F.when((before == "") | before.rlike(f"{SPACE}$") | addition.rlike(f"^(?:{SPACE}|[.,;:!?])"), "").otherwise(" ")
    right = F.when((after == "") | after.rlike(f"^(?:{SPACE}|[.,;:!?])"), "").otherwise(" ")
    return F.concat(before, left, addition, right, after)
