"""Connected components, and linking inside candidate groups without listing all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import discard, durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the component is its smallest id.

    Distributed union-find by alternating stars: every node hands its larger
    neighbours to the smallest node it knows, then its smaller ones, until the
    edges stay the same. Minima are pre-aggregated; no neighbourhood is collected.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = durable(small)
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: Callable[[Column, Column], Column] = lambda m, n: F.lit(True), stars: int = 2, shares: tuple[int, ...] = (16, 4, 1)) -> tuple[DataFrame, DataFrame]:
    """(verified links, components) of ids that share a key of ``members`` (key, id, n); ``verify`` keeps true pairs (a, b).

    ``possible`` tells from what two members of a key carry in ``n`` whether the pair can be true and this its first
    common key; others are not made here.
    In each of ``stars`` rounds the smallest id of a key is compared with the
    members that are not yet in its component, and leaves the key. Keys whose
    members have all met drop out, so a large group of copies costs pairs in
    proportion to its size. Then every pair that is left has its turn, unless
    the two have become connected: first a sixteenth of them by hash, then a
    quarter, then the rest, so that most of a dense group is connected before
    its pairs come up. No two ids that share a key and lie in different
    components at the end have gone without a comparison.
    """
    alive = durable(members.select("key", "id", "n").distinct())
    links = tried = labels = None
    for part in (*[0] * stars, *shares):
        now = alive.withColumn("c", F.col("id")) if labels is None else alive.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
        keys = now.groupBy("key").agg(F.min(F.struct("id", "c", "n")).alias("lead"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key", "lead")
        open_ = durable(now.join(keys, "key"))
        discard(alive)
        if not part:
            pairs = open_.filter((F.col("c") != F.col("lead.c")) & possible(F.col("n"), F.col("lead.n"))).select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
        else:
            other = open_.select("key", F.col("id").alias("b"), F.col("c").alias("d"), F.col("n").alias("m"))
            both = open_.select("key", F.col("id").alias("a"), "c", "n").join(other, "key").filter("a < b and c <> d")
            both = both.filter(F.pmod(F.xxhash64("a", "b"), F.lit(part)) == 0)
            pairs = both.filter(possible(F.col("n"), F.col("m"))).select("a", "b")
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        if not pairs.head(1):
            if not open_.head(1):
                break
        else:
            found = durable(verify(pairs))
            links = found if links is None else links.union(found)
            tried = pairs if tried is None else tried.union(pairs)
            labels = durable(components(links))
        alive = durable((open_ if part else open_.filter("id <> lead.id")).select("key", "id", "n"))
        discard(open_)
    spark = members.sparkSession
    kind = dict(members.dtypes)["id"]
    if links is None:
        links = spark.createDataFrame([], f"a {kind}, b {kind}")
        labels = spark.createDataFrame([], f"id {kind}, component {kind}")
    return links, labels
