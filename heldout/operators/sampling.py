"""Seeded selections: first k by hash, candidate sets, target ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_index, sha256
from .durable import durable
from .ranking import positions, top_k


def hash_first(df: DataFrame, group: list[str], item: str, k: int, seed, purpose: str) -> DataFrame:
    """The first k items of each group in hash order."""
    keyed = df.withColumn("_h", sha256(F.lit(seed), F.lit(purpose), item))
    return top_k(keyed, group, ["_h", item], k).drop("_h")


def sampled_sets(df: DataFrame, pool: list[str], item: str, size: int, seed) -> DataFrame:
    """For each item a set of itself and ``size - 1`` others of its pool, in hash order.

    The pool lies on a ring in hash order. Seen from a target, the rest of the
    ring is cut into ``size - 1`` equal stretches and the target draws one item of
    each by its own hash, so sets of two targets are drawn apart. Work and output
    grow with items x size, never with the square of a pool. Pools below ``size``
    give no sets; ``small_pools`` lists them.
    """
    keyed = df.select(*pool, item).withColumn("_h", sha256(F.lit(seed), F.lit("pool"), item))
    n = df.groupBy(*pool).agg(F.count(F.lit(1)).alias("_n"))
    ring = durable(positions(keyed, pool, ["_h", item], "_p").drop("_h").join(n, pool).filter(F.col("_n") >= size))
    runs = ring.select(*pool, F.col(item).alias("target"), "_p", "_n", F.explode(F.sequence(F.lit(0), F.lit(size - 2))).alias("_j"))
    low, high = [F.floor((F.col("_n") - 1) * j / F.lit(size - 1)) for j in (F.col("_j"), F.col("_j") + 1)]
    step = low + hash_index(high - low, F.lit(seed), F.lit("draw"), "target", "_j")
    spots = runs.select(*pool, "target", ((F.col("_p") + 1 + step) % F.col("_n")).alias("_p"))
    negatives = spots.join(ring.select(*pool, "_p", F.col(item).alias("candidate")), [*pool, "_p"]).select("target", "candidate", F.lit(False).alias("is_target"))
    members = negatives.unionByName(ring.select(F.col(item).alias("target"), F.col(item).alias("candidate"), F.lit(True).alias("is_target")))
    order = members.withColumn("_h", sha256(F.lit(seed), F.lit("order"), "target", "candidate"))
    return top_k(order, ["target"], ["_h", "candidate"], size, "position").withColumn("position", F.col("position") - 1).drop("_h")


def small_pools(df: DataFrame, pool: list[str], size: int) -> DataFrame:
    """Pools from which no set of ``size`` can be drawn, with their count and the reason."""
    n = df.groupBy(*pool).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") < size).withColumn("reason", F.lit("POOL_BELOW_SET_SIZE"))


def target_ranks(scored: DataFrame, target: str, score: str, position: str, is_target: str) -> DataFrame:
    """Rank of each target among its candidates: higher score first, then lower position."""
    own = scored.filter(is_target).select(target, F.col(score).alias("_s"), F.col(position).alias("_o"))
    ahead = (F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(position) < F.col("_o")))
    return scored.join(own, target).groupBy(target).agg((F.sum(F.when(ahead, 1).otherwise(0)) + 1).alias("rank"))
