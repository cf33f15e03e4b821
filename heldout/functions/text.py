"""Text normalisers, tokens and string predicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip().casefold())


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip())


@F.pandas_udf(ArrayType(StringType()))
def _fold_each(s: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(w):
        if w is None:
            return None
        if w not in known:
            known[w] = unicodedata.normalize("NFKC", w).strip().casefold()
        return known[w]

    return s.map(lambda words: None if words is None else [one(w) for w in words])


def fold_tokens(c: Column) -> Column:
    """``fold_text`` of every word of an array; each distinct word of a batch is folded once."""
    return _fold_each(c)


def fold_text(c: Column) -> Column:
    """NFKC, strip, casefold. Spark SQL has neither NFKC nor casefold, so Arrow batches are used."""
    return _fold(c)


def compose_text(c: Column) -> Column:
    """NFKC and strip, case kept."""
    return _compose(c)


def fold_without_spaces(c: Column) -> Column:
    return F.regexp_replace(_fold(c), r"(?U)\s+", "")


def collapse_spaces(c: Column) -> Column:
    """NFKC, runs of white space to one blank, ends stripped, trailing semicolons dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(_compose(c), r"(?U)\s+", " ")), ";+$", "")


def tokens(c: Column) -> Column:
    """White-space tokens; an empty text gives an empty array."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def trigrams(c: Column) -> Column:
    """All character trigrams in order; texts shorter than three give an empty array."""
    n = F.char_length(c)
    return F.when(
        n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3)))
    ).otherwise(F.array().cast("array<string>"))


def key_prefix(c: Column, parts: int) -> Column:
    """The first ``parts`` pieces of a '|' key."""
    return F.array_join(F.slice(F.split(c, r"\|"), 1, parts), "|")


# Surface forms that stand for a missing word.
PLACEHOLDERS = ["", "<na>", "<null>", "n/a", "na", "nan", "none", "null", "placeholder"]


def item_reason(raw: Column, is_word: Column | None = None) -> Column:
    """Why a token is no lexical item, first rule wins; NULL when it is accepted.

    Order: placeholder, the caller's word predicate, no letter at all.
    """
    folded = fold_text(raw)
    return (
        F.when(folded.isNull() | folded.isin(PLACEHOLDERS), "placeholder_or_empty")
        .when(~is_word if is_word is not None else F.lit(False), "official_is_real_word_false")
        .when(~folded.rlike(r"\p{L}"), "numeric_or_nonlexical")
    )
