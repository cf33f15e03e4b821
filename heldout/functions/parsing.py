"""Lenient parsers and row predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a boolean.
TRUE_WORDS = ["1", "true", "yes", "y", "include", "included"]
FALSE_WORDS = ["0", "false", "no", "n", "exclude", "excluded"]


def lenient_bool(c: Column, default: bool = True) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False).otherwise(default)


def count_or_null(c: Column) -> Column:
    """A finite, non-negative whole number as a long, else NULL."""
    d = c.cast("string").try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < 9.0e18) & (F.floor(d) == d)
    return F.when(ok, d.cast("long"))


def first_present(df, names, default=None) -> Column:
    """The first non-NULL of those columns that the table has, trimmed, as a string."""
    have = [F.trim(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default).cast("string")


def length_legal(target: Column, other: Column) -> Column:
    """Inclusive 0.75 to 1.25 length ratio in whole numbers: 3a <= 4b <= 5a."""
    t, o = target.cast("long"), other.cast("long")
    return (t * 3 <= o * 4) & (o * 4 <= t * 5)


def similarity_legal(cosine: Column, threshold: float) -> Column:
    """Only strictly greater than the threshold is excluded."""
    return cosine <= F.lit(threshold)


def reasons(*rules) -> Column:
    """Sorted array of the names of the rules that hold; each rule is (condition, name).

    The order is settled here, and rows without a fault skip the array work.
    """
    rules = sorted(rules, key=lambda r: r[1])
    none = F.lit(True)
    for cond, _ in rules:
        none = none & ~F.coalesce(cond, F.lit(False))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules])))


def first_reason(*rules, default=None) -> Column:
    """Name of the first rule that holds, in the order given."""
    out = F.lit(default).cast("string") if default is None else F.lit(default)
    for cond, name in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out
