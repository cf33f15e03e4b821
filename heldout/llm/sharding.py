"""Sharding by sampled splitters: shards of near equal bytes over a range order of the texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heldout.operators.durable import durable

from .numbering import numbered
from .registry import query

#: Ranges that splitters aim at, samples drawn per range, and the share of a shard up to which equal texts stay together.
RANGES, SAMPLES, TOGETHER = 256, 64, 0.01


def _quantiles(sample: list[tuple[str, str, float]], parts: int) -> list[str]:
    """Splitters at equal weights. A group of equal texts is cut inside only if it spans a whole part."""
    sample = sorted(sample)
    weights = np.cumsum([s[2] for s in sample])
    cuts: list[str] = []
    for i in np.searchsorted(weights, weights[-1] * np.arange(1, parts) / parts) if sample else []:
        group, rest, _ = sample[min(i, len(sample) - 1)]
        cut = group if not cuts or not cuts[-1].startswith(group) else group + rest
        if not cuts or cut > cuts[-1]:
            cuts.append(cut)
    return cuts


def _placed(rows: DataFrame, cuts: list[str]) -> DataFrame:
    bounds = np.array(cuts or [""], dtype=object)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(dtype=object), side="right"))

    return rows.withColumn("range", number(F.concat("group", "rest")))


def _sample(rows: DataFrame, wanted: int, total: int) -> list[tuple[str, str, float]]:
    """Rows drawn with a chance proportional to their weight, by a hash: about ``wanted``, twice that at most in the mean."""
    step = total / wanted
    chance = F.pmod(F.xxhash64(F.lit(7), "group", "rest"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.filter(chance * F.lit(step) < F.col("weight")).select("group", "rest", F.greatest("weight", F.lit(step)).alias("w"))
    return [tuple(r) for r in drawn.collect()]


def shard(docs: DataFrame, shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """One row per document: its shard and its slot there.

    The order is by the hash of the text, then by the hash of the id. Splitters
    from a size-weighted sample cut it into ranges; ranges found overfull by
    exact sums are sampled and cut again, inside a group of equal texts where
    one alone is too large. Bytes summed over the ranges place every row on the
    scale 0..total, which the shards share equally. Groups up to ``TOGETHER``
    of a shard stay in one shard, larger ones may span several. A row weighs
    its size and the mean size, so ranges of very many tiny rows are cut as well.

    NULL text has size 1 like the empty text but is a group of its own; NULL
    ids sort first; repeated rows take slots of their own in either order; an
    empty table gives no rows. Only samples and one row per range visit the
    driver, both bounded by parameters.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    # the leading blank keeps NULL text before all hashes; rows of equal text and id are alike, but a number lets a cut go between them
    rest = F.concat_ws(" ", F.lit(""), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    rows = durable(docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5("text"), F.lit("")).alias("group"), rest.alias("rest")))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total // max(1, n_rows)
    rows, weights = rows.withColumn("weight", F.col("size") + mean), total + mean * n_rows
    cuts = _quantiles(_sample(rows, ranges * SAMPLES, weights), ranges) if total else []
    for _ in range(3):
        filled = _placed(rows, cuts).groupBy("range").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows")).collect()
        over = {r["range"]: r["weight"] for r in filled if r["weight"] > 2 * weights / ranges and r["rows"] > 1}
        if not over:
            break
        more = _sample(_placed(rows, cuts).filter(F.col("range").isin(list(over))), max(1, round(SAMPLES * sum(over.values()) * ranges / weights)), sum(over.values()))
        by_range: dict[int, list] = {}
        for s, r in zip(more, np.searchsorted(np.array(cuts or [""], dtype=object), np.array([a + b for a, b, _ in more], dtype=object), side="right"), strict=True):
            by_range.setdefault(int(r), []).append(s)
        cuts = sorted({*cuts, *(c for r, s in by_range.items() for c in _quantiles(s, max(2, round(over.get(r, 0) * ranges / weights))))})
    before = [(None, 0, 0)]
    cut = _placed(rows, cuts)
    at, row = 0, 0
    for r in sorted(cut.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()):
        before.append((r["range"], at, row))
        at, row = at + r["bytes"], row + r["rows"]
    offsets = rows.sparkSession.createDataFrame(before, "range int, _at long, _row long")
    run = W.partitionBy("range").orderBy("group", "rest")
    peers = W.partitionBy("range").orderBy("group").rangeBetween(W.currentRow, W.currentRow)
    local = cut.withColumns({"_end": F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0)), "_n": F.row_number().over(run)})
    local = local.withColumns({"_whole": F.sum("size").over(peers), "_first": F.min(F.col("_end") - F.col("size")).over(peers)})
    local = local.join(F.broadcast(offsets), "range")  # size bound: one row per range
    fair = total / shards
    middle = F.when(F.col("_whole") <= TOGETHER * fair, F.col("_at") * 2 + F.col("_first") * 2 + F.col("_whole")).otherwise(F.col("_at") * 2 + F.col("_end") * 2 - F.col("size"))
    number = F.least(F.floor(middle * shards / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int")
    placed = durable(local.select("doc_id", "size", "text_crc32", "group", number.alias("shard"), (F.col("_row") + F.col("_n") - 1).alias("_place")))
    first = placed.groupBy("shard").agg(F.min("_place").alias("_start"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "group", "shard", (F.col("_place") - F.col("_start")).alias("slot"))  # size bound: one row per shard


def write_shards(docs: DataFrame, sharded: DataFrame, folder: str) -> None:
    """Write the documents as one folder per shard, rows in slot order. Rows are matched by id, text and their number among equal ones."""
    keys, names = ["_g", "_d"], docs.columns
    left = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.md5("text"), F.lit("")).alias("_g"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"))
    right = sharded.select(F.col("group").alias("_g"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.struct("shard", "slot").alias("_at"))
    rows = numbered(left, keys, [F.xxhash64(F.to_json("_row"))], "_n").join(numbered(right, keys, [F.col("_at")], "_n"), [*keys, "_n"])
    kept = [F.col(f"_row.`{n}`").alias(n) for n in names if n not in ("shard", "slot")]
    rows.select(*kept, F.col("_at.shard").alias("shard"), F.col("_at.slot").alias("slot")).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


@query("op6_sharding", "documents")
def op6(documents: DataFrame) -> DataFrame:
    """Eight shards of near equal bytes."""
    out = shard(documents)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
