"""Support, coverage and population profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, small
from .ranking import exact_quantiles


def n_rows() -> Column:
    return F.count(F.lit(1))


def count_when(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def item_support(df, item, entity, min_rows=20, min_entities=5, dedup=None) -> DataFrame:
    """Rows and distinct entities per item, and whether both minima hold.

    ``dedup`` names the columns within which an item counts once.
    """
    base = df.select(*dedup, entity).distinct() if dedup else df
    pairs = base.groupBy(item, entity).agg(n_rows().alias("_n"))  # copies merge before the second shuffle
    out = pairs.groupBy(item).agg(F.sum("_n").alias("n_observations"), n_rows().alias("n_subjects"))
    return out.withColumn("supported", (F.col("n_observations") >= min_rows) & (F.col("n_subjects") >= min_entities))


def support_summary(df, item, entity, min_rows=20, min_entities=5, redline=0.20) -> DataFrame:
    """One row over all items: counts, rate, sparsity, quartiles, coverage and the red line."""
    items = item_support(df, item, entity, min_rows, min_entities)
    per_entity = df.select(item, entity).distinct().groupBy(entity).agg(n_rows().alias("items"))
    a = items.agg(
        n_rows().alias("item_count"), F.sum("n_observations").alias("n_observations"),
        count_when(F.col("supported")).alias("supported_item_count"), F.sum("n_subjects").alias("observed_cells"),
    )
    q = exact_quantiles(items, [], "n_observations", {"q1": 0.25, "q3": 0.75}, "floor_index")
    m = exact_quantiles(items, [], "n_observations", {"median": 0.5})
    c = exact_quantiles(per_entity, [], "items", {"coverage_items_median": 0.5}).join(
        F.broadcast(per_entity.agg(n_rows().alias("subject_count"))))
    out = a.join(F.broadcast(q)).join(F.broadcast(m)).join(F.broadcast(c))  # one row each
    rate = F.col("supported_item_count") / F.col("item_count")
    return out.select(
        "item_count", "n_observations", "supported_item_count", F.round(rate, 8).alias("supported_item_rate"),
        F.when(rate < redline, "NO_GO").otherwise("PASS").alias("redline_status"),
        F.col("median").cast("double").alias("median"), F.col("q1").cast("double").alias("q1"), F.col("q3").cast("double").alias("q3"),
        "subject_count", "observed_cells",
        F.round(1 - F.col("observed_cells") / (F.col("item_count") * F.col("subject_count")), 8).alias("sparsity"),
        F.round(F.col("coverage_items_median") / F.col("item_count"), 8).alias("coverage_median"),
    )


def five_numbers(df, group, value) -> DataFrame:
    """Count, min, floor-index quartiles, mean-of-middle median and max per group."""
    q = exact_quantiles(df, group, value, {"q1": 0.25, "q3": 0.75}, "floor_index")
    m = exact_quantiles(df, group, value, {"median": 0.5})
    a = df.groupBy(*group).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))
    if group:
        return a.join(q, group).join(m, group)
    return a.join(F.broadcast(q)).join(F.broadcast(m))  # one row each


def entity_first(rows, entity, cell, metrics, eligible="eligible", reason="exclusion_reason") -> tuple[DataFrame, DataFrame]:
    """(entity means over eligible cells, excluded rows with reasons). Missing cells are never filled."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    numbers = [F.col(m) for m in metrics]
    missing = numbers[0].isNull()
    nonfinite = F.lit(False)
    for m in numbers:
        missing = missing | m.isNull()
        nonfinite = nonfinite | F.isnan(m) | (F.abs(m) == float("inf"))
    why = (
        F.when(blank(entity) | blank(cell), "MISSING_SUBJECT_OR_CELL")
        .when(~F.coalesce(F.col(eligible), F.lit(True)), F.coalesce(F.col(reason), F.lit("INELIGIBLE_CELL")))
        .when(missing, "INVALID_METRIC")
        .when(nonfinite, "NONFINITE_METRIC")
    )
    tagged = rows.withColumn("reason", why)
    means = tagged.filter("reason is null").groupBy(entity).agg(
        n_rows().alias("n_eligible_cells"), *[F.avg(m).alias(m) for m in metrics]
    )
    return means, tagged.filter("reason is not null")


def mean_cascade(df, levels, metrics) -> DataFrame:
    """Equal-weight means level by level: each list of keys averages the level before it."""
    for keys in levels:
        df = df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
    return df


def balanced_recall(df, truth, prediction, group=()) -> DataFrame:
    """Mean over true classes of the share predicted right."""
    per_class = df.groupBy(*group, truth).agg(F.avg(F.when(F.col(truth) == F.col(prediction), 1.0).otherwise(0.0)).alias("_r"))
    return per_class.groupBy(*group).agg(F.avg("_r").alias("balanced_recall"), n_rows().alias("classes"))


def precision_recall(df, truth: Column, predicted: Column, group=()) -> DataFrame:
    """Precision, recall and F1 with 0 where a denominator is empty."""
    c = df.groupBy(*group).agg(
        count_when(truth & predicted).alias("tp"), count_when(~truth & predicted).alias("fp"), count_when(truth & ~predicted).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("precision", p).withColumn("recall", r)
    return c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_support(df, label, classes: DataFrame) -> DataFrame:
    """Rows per registered class, empty classes included."""
    counts = df.groupBy(label).agg(n_rows().alias("n"))
    return classes.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def coverage_levels(df, levels: list[list[str]], available: Column) -> DataFrame:
    """Targets, available targets and coverage at several grouping levels in one pass."""
    keys = sorted({c for lv in levels for c in lv})
    flagged = df.withColumn("_a", F.when(available, 1).otherwise(0)).groupBy(*keys).agg(n_rows().alias("_n"), F.sum("_a").alias("_s"))
    out = flagged.groupingSets([[F.col(c) for c in lv] for lv in levels], *keys).agg(
        F.sum("_n").alias("targets"), F.sum("_s").alias("available"))
    return out.withColumn("coverage", F.col("available") / F.col("targets"))


def every_pair(left: DataFrame, right: DataFrame, width: int = 1000) -> DataFrame:
    """Each left row with each right row, for results that are a full grid by definition.

    The right side is written and packed into numbered rows of about ``width``
    each. Left rows stay where they are: they visit every packed row by a join
    that is broadcast while counted rows and bytes allow, and unpack it there.
    """
    fixed = durable(right)
    buckets = max(1, -(-fixed.count() // width))
    dealt = fixed.select(F.pmod(F.xxhash64(*right.columns), F.lit(buckets)).cast("int").alias("_bucket"), F.struct(*right.columns).alias("_r"))
    packed = small(dealt.groupBy("_bucket").agg(F.collect_list("_r").alias("_rows")))  # about width rows
    visits = left.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(packed, "_bucket")
    return visits.select(*[visits[c] for c in left.columns], F.inline("_rows"))


def full_grid(left: DataFrame, right: DataFrame, facts: DataFrame, keys: list[str], reason: str = "MISSING") -> DataFrame:
    """All combinations of two dimension tables with counts, a covered flag and a reason.

    Both sides must be distinct dimension keys.
    """
    counts = facts.groupBy(*keys).agg(n_rows().alias("n"))
    grid = every_pair(left, right).join(counts, keys, "left")
    return grid.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"),
                       F.when(F.col("n").isNull(), reason).alias("reason"))


def dependency_conflicts(df, determinant: list[str], dependent: str) -> DataFrame:
    """Keys with more than one value of a column they should determine."""
    pairs = df.select(*determinant, dependent).distinct()
    return pairs.groupBy(*determinant).agg(n_rows().alias("variants")).filter("variants > 1")


def robust_statistics(df, group, value) -> DataFrame:
    """Extreme quantiles, range, median absolute deviation and non-finite count per group."""
    x = F.col(value)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = df.filter(finite)
    probs = {"q001": 0.001, "q01": 0.01, "median": 0.5, "q99": 0.99, "q999": 0.999}
    q = exact_quantiles(good, group, value, probs)
    dev = good.join(q.select(*group, "median"), group).withColumn("_d", F.abs(x - F.col("median")))
    mad = exact_quantiles(dev, group, "_d", {"mad": 0.5})
    ends = df.groupBy(*group).agg(
        F.min(F.when(finite, x)).alias("min"), F.max(F.when(finite, x)).alias("max"), count_when(~finite).alias("nonfinite"))
    return ends.join(q, group, "left").join(mad, group, "left")


def collapse_events(df, keys, flags_any, labels_any, single: str | None = None) -> DataFrame:
    """One row per event key: any true flag, nullable any label, and the single value or -1."""
    aggs = [F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags_any] + [F.bool_or(lb).alias(lb) for lb in labels_any]
    if single:
        aggs.append(F.when(F.min(single) == F.max(single), F.min(single)).otherwise(-1).alias(single))
    return df.groupBy(*keys).agg(*aggs, n_rows().alias("samples"))


def single_offset(df, left: Column, right: Column) -> DataFrame:
    """Whether one offset explains every row."""
    per = df.groupBy((left - right).alias("offset")).agg(n_rows().alias("n"))
    return per.agg(n_rows().alias("offsets"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.sum("n").alias("rows")) \
        .withColumn("single_global_offset", F.col("offsets") == 1)


def structural_bound(df, group, item, needed=49) -> DataFrame:
    """Most negatives any target of a group can have (pool - 1) against the number needed."""
    pool = df.select(group, item).distinct().groupBy(group).agg(n_rows().alias("pool"))
    return pool.withColumn("max_negatives", F.col("pool") - 1).withColumn(
        "status", F.when(F.col("pool") - 1 >= needed, "POSSIBLE").otherwise("STRUCTURALLY_IMPOSSIBLE"))


def evidence_status(df, group, value, expected=None) -> DataFrame:
    """A value must be the same on every row of a group, and equal to ``expected`` if given."""
    a = df.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("high"), count_when(F.col(value).isNull()).alias("missing"))
    s = F.when(F.col("missing") > 0, "MISSING_EVIDENCE").when(F.col("low") != F.col("high"), "INCONSISTENT")
    if expected is not None:
        s = s.when(F.col("low") != F.lit(expected), "UNEXPECTED")
    return a.withColumn("status", s.otherwise("CONSISTENT"))
