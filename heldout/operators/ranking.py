"""Positions, running sums, neighbours and quantiles that survive hot groups.

A plain window puts every row of its group into one task. These forms cut the
sorted table by range into pieces, work inside each piece, and carry one small
row per piece over the cuts. A range cut can split at most one group, so the
carry table has at most two rows per piece, whatever the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import durable

PIECE = "_piece"


def _pieces(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Range-cut by (group, order) with the piece number written down.

    No piece count is given, so adaptive execution may merge small neighbours;
    merged ranges stay in order.
    """
    cut = df.repartitionByRange(*[F.col(g) for g in group], *order)
    return durable(cut.withColumn(PIECE, F.spark_partition_id()))


def _carry(cut: DataFrame, group: list[str], summary: Column, combine) -> DataFrame:
    """Per (group, piece) of groups that cross a cut: ``combine`` over the earlier pieces."""
    seg = cut.groupBy(PIECE, *group).agg(summary.alias("_s"))
    if group:
        crossing = (
            seg.groupBy(*group)
            .agg(F.min(PIECE).alias("_lo"), F.max(PIECE).alias("_hi"))
            .filter("_lo < _hi")
            .select(*[F.col(g).alias(f"_g_{g}") for g in group])
        )
        cond = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
        # size bound: at most one group per cut, so fewer rows than pieces
        seg = seg.join(F.broadcast(crossing), cond, "left_semi")
    before = W.partitionBy(*group).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    return seg.select(
        F.col(PIECE).alias("_cp"), *[F.col(g).alias(f"_c_{g}") for g in group],
        combine(F.col("_s")).over(before).alias("_carry"),
    )


def _attach(local: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    cond = F.col(PIECE) == F.col("_cp")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    # size bound: at most two rows per piece
    return local.join(F.broadcast(carry), cond, "left").drop("_cp", *[f"_c_{g}" for g in group])


def _plain_order(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running_sum(df, group, order, value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in a total order inside each group."""
    order = _plain_order(order)
    cut = _pieces(df.withColumn("_v", value), group, order)
    carry = _carry(cut, group, F.sum("_v"), F.sum)
    w = W.partitionBy(PIECE, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_r", F.sum("_v").over(w))
    both = _attach(local, carry, group)
    return both.withColumn(out, F.col("_r") + F.coalesce(F.col("_carry"), F.lit(0))).drop(
        PIECE, "_v", "_r", "_carry"
    )


def running_max(df, group, order, value: Column, out: str) -> DataFrame:
    """Largest ``value`` up to each row in a total order inside each group; NULLs are passed over."""
    order = _plain_order(order)
    cut = _pieces(df.withColumn("_v", value), group, order)
    carry = _carry(cut, group, F.max("_v"), F.max)
    w = W.partitionBy(PIECE, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = _attach(cut.withColumn("_r", F.max("_v").over(w)), carry, group)
    return both.withColumn(out, F.greatest("_r", "_carry")).drop(PIECE, "_v", "_r", "_carry")  # greatest skips NULL


def positions(df, group, order, out: str = "position") -> DataFrame:
    """Zero-based position of each row in a total order inside its group."""
    ranked = running_sum(df, group, order, F.lit(1).cast("long"), out)
    return ranked.withColumn(out, F.col(out) - 1)


def neighbours(df, group, order, columns: dict[str, str], offset: int) -> DataFrame:
    """Value of each column ``offset`` rows away (negative looks back), as ``columns[name]``.

    Works through positions, so a hot group is never one window.
    """
    ranked = positions(df, group, order, "_p")  # read from its written pieces
    keys = [*group, "_p"]
    shifted = ranked.select(
        *group, (F.col("_p") - offset).alias("_p"), *[F.col(c).alias(o) for c, o in columns.items()]
    )
    return ranked.join(shifted, keys, "left").drop("_p")


def preceding(df, group, order, value: str, width: int, out: str) -> DataFrame:
    """Array of the at most ``width`` values just before each row, oldest first.

    Each row hands its value to the ``width`` rows after it; a group of any size is spread out.
    """
    ranked = positions(df, group, order, "_p")  # read from its written pieces
    given = ranked.select(*group, F.explode(F.sequence(F.lit(1), F.lit(width))).alias("_d"), "_p", F.col(value).alias("_x"))
    given = given.select(*group, (F.col("_p") + F.col("_d")).alias("_p"), F.struct((-F.col("_d")).alias("d"), F.col("_x").alias("x")).alias("_s"))
    packed = given.groupBy(*group, "_p").agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    joined = ranked.join(packed, [*group, "_p"], "left")
    t = df.schema[value].dataType.simpleString()
    return joined.withColumn(
        out, F.coalesce(F.transform("_a", lambda s: s["x"]), F.array().cast(f"array<{t}>"))
    ).drop("_a", "_p")


def top_k(df, group, order, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group, ranks from 1. Spark cuts each map task to k rows before the shuffle."""
    w = W.partitionBy(*group).orderBy(*_plain_order(order))
    return df.withColumn(out, F.row_number().over(w).cast("long")).filter(F.col(out) <= k)


def value_ranks(df, group, value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their count and the number of rows up to and including them.

    Equal values are counted before anything is sorted, so copies cost nothing.
    """
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(counted, group, [value], F.col("_n"), "_cum")
    total = cum.groupBy(*group).agg(F.sum("_n").alias("_total"))  # from the written pieces, not the source
    return cum, total


def _join_group(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    if group:
        return a.join(b, group)
    return a.join(F.broadcast(b))  # one row: the grand total


def order_statistics(df, group, value: str, probs: dict[str, float], rule: str = "linear") -> DataFrame:
    """Per group and name: the two neighbouring order statistics and the weight between them.

    Columns ``<name>_lo``, ``<name>_hi``, ``<name>_at``. Rules: ``linear``
    interpolates at p(n-1); ``lower`` takes the ceil(pn)-th smallest;
    ``floor_index`` the element at index floor(p(n-1)). NULLs are left out.
    Equal values merge first and the sort is spread by range.
    """
    clean = df.select(*group, F.col(value).alias("_x")).filter(F.col("_x").isNotNull())
    cum, total = value_ranks(clean, group, "_x")
    cum = _join_group(cum, total, group)
    last = F.col("_total") - 1
    start = F.col("_cum") - F.col("_n")
    pick = lambda i: F.max(F.when((start <= i) & (i < F.col("_cum")), F.col("_x")))
    aggs = []
    for name, p in probs.items():
        if rule == "lower":
            lo = hi = F.greatest(F.ceil(F.lit(p) * F.col("_total")) - 1, F.lit(0))
            at = F.lit(0.0)
        elif rule == "floor_index":
            quarters = round(p * 4)
            lo = hi = F.floor(last * quarters / 4) if abs(p * 4 - quarters) < 1e-12 else F.floor(last * p)
            at = F.lit(0.0)
        else:
            spot = last.cast("double") * F.lit(p)
            lo, hi, at = F.floor(spot), F.ceil(spot), spot - F.floor(spot)
        aggs += [pick(lo).alias(f"{name}_lo"), pick(hi).alias(f"{name}_hi"), F.max(at).alias(f"{name}_at")]
    return cum.groupBy(*group).agg(*aggs)


def between(name: str, change=lambda c: c) -> Column:
    """The quantile from its two order statistics, each passed through ``change`` first."""
    lo, hi = change(F.col(f"{name}_lo")), change(F.col(f"{name}_hi"))
    return lo + (hi - lo) * F.col(f"{name}_at")


def exact_quantiles(df, group, value: str, probs: dict[str, float], rule: str = "linear") -> DataFrame:
    """One row per group with exact quantiles named by ``probs``; see ``order_statistics``."""
    stats = order_statistics(df, group, value, probs, rule)
    if rule == "linear":
        return stats.select(*group, *[between(n).alias(n) for n in probs])
    return stats.select(*group, *[F.col(f"{n}_lo").alias(n) for n in probs])


def average_ranks(df, group, value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1 with ties given their mean rank."""
    cum, _ = value_ranks(df, group, value)
    ranks = cum.select(*group, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*group, value])
