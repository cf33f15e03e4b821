"""Contrasts, resampling, rank statistics and decision rules."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_index, sha256
from .durable import durable, small
from .ranking import average_ranks, exact_quantiles, neighbours, positions, value_ranks


def contributions(real: Column, nulls: dict[str, Column]) -> dict[str, Column]:
    """Real minus the mean, minus the largest, and minus each null."""
    total = None
    for c in nulls.values():
        total = c if total is None else total + c
    out = {"u_oof": real - total / len(nulls), "u_min": real - F.greatest(*nulls.values())}
    return out | {f"real_minus_{k}": real - c for k, c in nulls.items()}


def bootstrap_draws(values: DataFrame, entity: str, value: str, draws: int, seed) -> DataFrame:
    """Mean of one resample of the entities per draw; each index comes from a hash.

    Entities, never rows, are resampled: give one row per entity.
    """
    ranked = small(positions(values.select(entity, value), [], [entity], "_i").select("_i", value), rows=2_000_000)
    n = ranked.count()
    # every task makes an even share of the places of all draws; after the join one sum per draw leaves it
    slots = values.sparkSession.range(n * draws).select((F.col("id") % draws).cast("int").alias("draw"), F.expr(f"id div {draws}").alias("_s"))
    picked = slots.select("draw", hash_index(n, F.lit(seed), "draw", "_s").alias("_i"))
    return picked.join(ranked, "_i").groupBy("draw").agg((F.sum(value) / n).alias("estimate"))


def cluster_bootstrap(values: DataFrame, entity: str, value: str, draws: int, seed, estimate: DataFrame | None = None) -> DataFrame:
    """One row: estimate, percentile 95% interval, entities and how many are positive.

    ``estimate`` (one row, one column) replaces the mean of entities as the point estimate.
    """
    d = bootstrap_draws(values, entity, value, draws, seed)
    # at most ``draws`` values
    ci = d.agg(F.percentile("estimate", F.lit(0.025)).alias("ci_low"), F.percentile("estimate", F.lit(0.975)).alias("ci_high"))
    a = values.agg(F.avg(value).alias("estimate"), F.count(F.lit(1)).alias("n_entities"),
                   F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).alias("positive_entities"))
    if estimate is not None:
        a = a.drop("estimate").join(F.broadcast(estimate.toDF("estimate")))  # one row
    return a.join(F.broadcast(ci))  # one row each


def paired_differences(a: DataFrame, b: DataFrame, entity: str, value: str) -> DataFrame:
    """b minus a per entity; raises unless both sides hold exactly the same entities."""
    unmatched = a.select(entity).exceptAll(b.select(entity)).unionByName(b.select(entity).exceptAll(a.select(entity)))
    if not unmatched.isEmpty():
        raise ValueError("paired tables hold different entities")
    return a.select(entity, F.col(value).alias("_a")).join(b.select(entity, F.col(value).alias("_b")), entity).select(
        entity, (F.col("_b") - F.col("_a")).alias("difference"))


def _hypergeometric(total: int, marked: int, taken: int, u: np.ndarray) -> np.ndarray:
    """Marked ones among ``taken`` of ``total``, for each uniform number the least count whose probability sums reach it.

    Counts further than fourteen deviations from the mean have no weight in double precision.
    """
    low, high = max(0, taken + marked - total), min(marked, taken)
    if low == high:
        return np.full(len(u), low)
    mean = taken * marked / total
    reach = 14 * np.sqrt(mean * (1 - marked / total) * (total - taken) / (total - 1)) + 20
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    x = np.arange(low, high, dtype=float)
    steps = np.r_[0.0, np.cumsum(np.log((marked - x) * (taken - x)) - np.log((x + 1) * (total - marked - taken + x + 1)))]
    sums = np.cumsum(np.exp(steps - steps.max()))
    return low + np.minimum(np.searchsorted(sums / sums[-1], u), high - low)


def _tables(labels: list[int], predictions: list[int], uniform) -> np.ndarray:
    """(draw, label, prediction) counts of labels dealt to predictions at random; ``uniform(label, prediction)`` has a number for each draw.

    Each class of predictions takes its labels class by class from what is left.
    """
    first = uniform(0, 0)
    left = np.tile(np.array(labels, np.int64), (len(first), 1))
    out = np.zeros((len(first), len(labels), len(predictions)), np.int64)
    for j, slots in enumerate(predictions[:-1]):
        open_, total = np.full(len(first), slots, np.int64), left.sum(axis=1)
        for k in range(len(labels) - 1):
            states, which = np.unique(np.stack([total, left[:, k], open_], axis=1), axis=0, return_inverse=True)
            u, x = uniform(k, j), np.zeros(len(first), np.int64)
            for s, (n, marked, taken) in enumerate(states.tolist()):
                x[which.ravel() == s] = _hypergeometric(n, marked, taken, u[which.ravel() == s])
            out[:, k, j] = x
            total, open_ = total - left[:, k], open_ - x
        out[:, -1, j] = open_
        left -= out[:, :, j]
    out[:, :, -1] = left
    return out


def permutation_null(df: DataFrame, row: str, block: str, truth: str, prediction: str, draws: int, seed, chunk: int = 256) -> DataFrame:
    """Balanced recall of fixed predictions under label shuffles inside blocks, one row per draw.

    The class sizes of the unshuffled labels stay the denominators. Only how
    often each label meets each prediction matters, so a draw deals each
    block's label counts to its prediction counts by hypergeometric draws from hashed
    uniforms: rows are counted once, and a draw costs classes squared. A
    block's draws go out in chunks. Rows without a label or prediction take part and hit nothing.
    """
    name = lambda c: F.col(c).cast("string")
    counts = df.groupBy(F.col(block).alias("_b"), name(truth).alias("_t"), name(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk))))

    def deal(c: pd.DataFrame) -> pd.DataFrame:
        start = int(c["_first"].iloc[0])
        group = c["_b"].iloc[0]
        numbers = range(start, min(start + chunk, draws))
        text = lambda x: None if pd.isna(x) else x
        sums: list[dict] = [{}, {}]
        for side, column in zip(sums, ("_t", "_p")):
            for x, n in zip(c[column], c["_n"]):
                side[text(x)] = side.get(text(x), 0) + int(n)
        order = lambda side: sorted(side, key=lambda x: (x is not None, x or ""))
        labels, given = order(sums[0]), order(sums[1])

        def uniform(k: int, j: int) -> np.ndarray:
            tail = [str(x) for x in (text(group), labels[k], given[j]) if x is not None]
            digest = (hashlib.sha256("|".join([str(seed), str(d), *tail]).encode()).hexdigest() for d in numbers)
            return np.array([int(h[:13], 16) for h in digest]) / float(1 << 52)

        table = _tables([sums[0][x] for x in labels], [sums[1][x] for x in given], uniform)
        rows = [(d, x, int(n)) for k, x in enumerate(labels) if x is not None and x in sums[1] for d, n in zip(numbers, table[:, k, given.index(x)])]
        return pd.DataFrame(rows, columns=["draw", "_label", "_hits"])

    # a group has at most classes squared rows
    dealt = parts.groupBy("_b", "_first").applyInPandas(deal, "draw int, _label string, _hits long")
    hit = dealt.groupBy("draw", "_label").agg(F.sum("_hits").alias("_hits"))
    sizes = df.groupBy(name(truth).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    classes = sizes.count()
    per = hit.join(sizes, "_label").groupBy("draw").agg((F.sum(F.col("_hits") / F.col("_size")) / classes).alias("recall"))
    every = df.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    return every.join(per, "draw", "left").select("draw", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def shuffled_labels_null(df: DataFrame, row: str, block: str, truth: str, prediction: str, draws: int, seed) -> DataFrame:
    """Balanced recall of fixed predictions when every row's label is dealt anew inside its block, one row per draw.

    The class sizes of the unshuffled labels stay the denominators. The labels of
    a block go in order of the hash of (seed, draw, row) to its predictions in
    order of the row; a large block is ranked by range, not in one task.
    """
    rows = df.select(block, F.col(truth).alias("_label"), F.col(row).alias("_r")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    dealt = positions(rows.withColumn("_h", F.unhex(sha256(F.lit(seed), "draw", "_r"))), ["draw", block], ["_h", "_r"], "_p").select("draw", block, "_p", "_label")
    slots = positions(df.select(row, block, prediction), [block], [row], "_p").select(block, "_p", prediction)
    hit = dealt.join(slots, [block, "_p"]).filter(F.col("_label") == F.col(prediction)).groupBy("draw", "_label").agg(F.count(F.lit(1)).alias("_hits"))
    sizes = df.groupBy(F.col(truth).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    classes = sizes.count()
    per = hit.join(sizes, "_label").groupBy("draw").agg((F.sum(F.col("_hits") / F.col("_size")) / classes).alias("recall"))
    every = df.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    return every.join(per, "draw", "left").select("draw", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def null_threshold(df: DataFrame, nulls: list[str], prob: float = 0.95) -> DataFrame:
    """Upper quantile of all pairwise null differences, both columns of each pair in order."""
    pairs = [F.col(a) - F.col(b) for i, a in enumerate(nulls) for b in nulls[i + 1:]]
    return exact_quantiles(df.select(F.explode(F.array(*pairs)).alias("d")), [], "d", {"threshold": prob})


def item_gate(df: DataFrame, item: str, entity: str, value: str, delta: DataFrame) -> DataFrame:
    """max(median over entities of the entity mean - delta, 0) per item."""
    means = df.groupBy(item, entity).agg(F.avg(value).alias("_m"))
    med = exact_quantiles(means, [item], "_m", {"_med": 0.5})
    return med.join(F.broadcast(delta)).select(item, F.greatest(F.col("_med") - F.col("threshold"), F.lit(0.0)).alias("gate"))  # one row


def rank_columns(df: DataFrame, values: list[str], group=()) -> DataFrame:
    """Average ranks of several columns as ``<name>_rank``."""
    for v in values:
        df = average_ranks(df, list(group), v, f"{v}_rank")
    return df


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; NULL when a column is constant."""
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str, group=()) -> DataFrame:
    """Rank correlation per group: NULL below two rows, 0 for a constant column."""
    r = rank_columns(df.select(*group, a, b), [a, b], group)
    n = F.count(F.lit(1))
    flat = (F.min(f"{a}_rank") == F.max(f"{a}_rank")) | (F.min(f"{b}_rank") == F.max(f"{b}_rank"))
    return r.groupBy(*group).agg(F.when(n < 2, None).when(flat, 0.0).otherwise(correlation(f"{a}_rank", f"{b}_rank")).alias("rho"), n.alias("n"))


def partial_spearman(df: DataFrame, a: str, b: str, controls: list[str]) -> DataFrame:
    """Correlation of the rank residuals of a and b given the controls, from the rank correlation matrix."""
    names = [a, b, *controls]
    r = rank_columns(df.select(*names), names)
    k = len(names)
    row = r.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"{names[i]}_rank", f"{names[j]}_rank").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n = row["n"]
    if n < 3:
        rho = None
    else:
        cross = cov[:2, 2:]
        left = cov[:2, :2] - (cross @ np.linalg.pinv(cov[2:, 2:]) @ cross.T if controls else 0)
        spread = np.sqrt(np.clip(np.diag(left), 0, None))
        rho = 0.0 if min(spread) < 1e-9 else float(left[0, 1] / (spread[0] * spread[1]))
    return df.sparkSession.createDataFrame([(rho, n)], "rho double, n long")


def rank_stability(df: DataFrame, replicate: str, item: str, value: str) -> DataFrame:
    """Smallest, median and largest rank correlation over pairs of replicates.

    Pairs are of replicates (a handful), joined item by item.
    """
    ranked = durable(average_ranks(df.select(replicate, item, value), [replicate], value, "_rank").select(replicate, item, "_rank"))
    left = ranked.select(F.col(replicate).alias("_a"), item, F.col("_rank").alias("_x"))
    right = ranked.select(F.col(replicate).alias("_b"), item, F.col("_rank").alias("_y"))
    pairs = left.join(right, item).filter("_a < _b").groupBy("_a", "_b").agg(F.coalesce(correlation("_x", "_y"), F.lit(0.0)).alias("rho"))
    # one value per pair of replicates
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.min("rho").alias("pairwise_min"), F.percentile("rho", F.lit(0.5)).alias("pairwise_median"), F.max("rho").alias("pairwise_max"))


def auroc(df: DataFrame, score: str, label: str, group=()) -> DataFrame:
    """Area under the ROC curve by rank sum, ties at their mean rank; NULL if a class is empty."""
    r = average_ranks(df.select(*group, score, label), list(group), score, "_rank")
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    total = F.sum(F.when(F.col(label) == 1, F.col("_rank")).otherwise(0.0))
    return r.groupBy(*group).agg(F.when((pos > 0) & (neg > 0), (total - pos * (pos + 1) / 2) / (pos * neg)).alias("auroc"), pos.alias("positives"), neg.alias("negatives"))


def weight_diagnostics(df: DataFrame, weight: str) -> DataFrame:
    """Normalised entropy, Gini and linear quantiles of non-negative weights with positive mass."""
    cum, _ = value_ranks(df, [], weight)
    total = df.agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("count"))
    x, n = F.col(weight), F.col("_n")
    p = x / F.col("_t")
    ranks = n * (F.col("_cum") - (n - 1) / 2.0)  # sum of the ranks of this value's copies
    out = cum.join(F.broadcast(total)).groupBy("count", "_t").agg(  # one row
        F.sum(F.when(x > 0, -n * p * F.log(p)).otherwise(0.0)).alias("_e"), F.sum(2 * x * ranks - n * x * (F.col("count") + 1)).alias("_g"))
    q = exact_quantiles(df, [], weight, {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return out.select("count", F.when(F.col("count") == 1, 1.0).otherwise(F.col("_e") / F.log(F.col("count"))).alias("normalized_entropy"),
                      (F.col("_g") / (F.col("count") * F.col("_t"))).alias("gini")).join(F.broadcast(q))


def top_quartile_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard overlap of the rows at or above each column's upper quartile."""
    qa = exact_quantiles(df, [], a, {"_qa": 0.75})
    qb = exact_quantiles(df, [], b, {"_qb": 0.75})
    x = df.join(F.broadcast(qa)).join(F.broadcast(qb))  # one row each
    ta, tb = F.col(a) >= F.col("_qa"), F.col(b) >= F.col("_qb")
    both, either = F.sum(F.when(ta & tb, 1).otherwise(0)), F.sum(F.when(ta | tb, 1).otherwise(0))
    return x.agg(F.when(either > 0, both / either).otherwise(1.0).alias("top_quartile_overlap"))


def recovery(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, mean absolute error after mean-one scaling, and upper-quartile overlap."""
    m = df.agg(F.greatest(F.avg(a), F.lit(1e-8)).alias("_ma"), F.greatest(F.avg(b), F.lit(1e-8)).alias("_mb"))
    e = df.join(F.broadcast(m)).agg(F.avg(F.abs(F.col(a) / F.col("_ma") - F.col(b) / F.col("_mb"))).alias("normalized_absolute_error"))
    return spearman(df, a, b).select("rho").join(F.broadcast(e)).join(F.broadcast(top_quartile_overlap(df, a, b)))  # one row each


def plateau_step(df: DataFrame, group: list[str], step: str, value: str, threshold: float = 0.005) -> DataFrame:
    """First step whose gain and the gain before it are both below the threshold; NULL if none."""
    one = neighbours(df.select(*group, step, value), group, [step], {value: "_v1"}, -1)
    two = neighbours(one, group, [step], {"_v1": "_v2"}, -1)
    hit = (F.col(value) - F.col("_v1") < threshold) & (F.col("_v1") - F.col("_v2") < threshold)
    return two.groupBy(*group).agg(F.min(F.when(hit, F.col(step))).alias("plateau_step"))


def first_sustained_level(df: DataFrame, group: list[str], level: str, passed: str) -> DataFrame:
    """First level above the lowest that passes together with the next one; NULL if none."""
    nxt = neighbours(df.select(*group, level, passed), group, [level], {passed: "_next"}, 1)
    low = df.groupBy(*group).agg(F.min(level).alias("_low"))
    j = nxt.join(low, group) if group else nxt.join(F.broadcast(low))
    return j.groupBy(*group).agg(F.min(F.when(F.col(passed) & F.coalesce("_next", F.lit(False)) & (F.col(level) > F.col("_low")), F.col(level))).alias("first_level"))


def family_decision(summary: DataFrame, contrasts: list[str], minimum_positive: int) -> DataFrame:
    """Detection from a wide row: interval above zero, enough positive entities, every contrast positive."""
    ok = (F.col("ci_low") > 0) & (F.col("positive_entities") >= minimum_positive)
    for c in contrasts:
        ok = ok & (F.col(c) > 0)
    failed = F.array_compact(F.array(
        F.when(F.col("ci_low") <= 0, "INTERVAL_INCLUDES_ZERO"), F.when(F.col("positive_entities") < minimum_positive, "TOO_FEW_POSITIVE"),
        *[F.when(F.col(c) <= 0, f"{c.upper()}_NOT_POSITIVE") for c in contrasts]))
    return summary.withColumn("family_detected", ok).withColumn("reasons", F.array_join(failed, ","))


def sign_of_interval(estimate: Column, low: Column, high: Column) -> Column:
    """Label of one interval, first rule wins."""
    return (F.when(high < 0, "SIGNIFICANT_NEGATIVE").when(estimate <= 0, "NONPOSITIVE_NOT_SIGNIFICANT")
            .when(low <= 0, "POSITIVE_UNDERPOWERED").otherwise("POSITIVE"))
