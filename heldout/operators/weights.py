"""Evidence weights of sentences from item scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles

# Floor share and numerical guard.
ETA, EPSILON = 0.1, 1e-8
GAMMAS = (0.5, 1.0, 2.0)


def _by(batch: list[str], left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    return left.join(right, batch, how) if batch else left.join(F.broadcast(right), F.lit(True), how)  # one row without keys


def floor_and_normalise(raw: DataFrame, batch: list[str], has_mass: Column, eta: float = ETA, epsilon: float = EPSILON) -> DataFrame:
    """Floor rows without mass at eta times the lower median of the others, then scale to mean one.

    ``raw`` has one row per sentence with column ``raw``. A batch without any mass gets ones.
    """
    tagged = raw.withColumn("_has", has_mass)
    median = exact_quantiles(tagged.filter("_has"), batch, "raw", {"_med": 0.5}, "lower")
    f = _by(batch, tagged, median).withColumn("all_zero_batch", F.col("_med").isNull())
    f = f.withColumn("floored", F.when(F.col("all_zero_batch"), 1.0).when(F.col("_has"), F.col("raw")).otherwise(eta * F.col("_med")))
    total = f.groupBy(*batch).agg(F.sum("floored").alias("_t"), F.count(F.lit(1)).alias("_n"))
    w = _by(batch, f, total)
    flat = F.col("_t") <= epsilon
    return w.select(
        *raw.columns, "floored", (~F.col("_has") & ~F.col("all_zero_batch") & ~flat).alias("floor_hit"),
        (F.col("all_zero_batch") | flat).alias("all_zero_batch"),
        F.when(flat, 1.0).otherwise(F.col("_n") * F.col("floored") / (F.col("_t") + epsilon)).alias("weight"))


def sentence_scores(items: DataFrame, keys: list[str], value: Column, active: Column) -> DataFrame:
    """Mean of ``value`` over active items per sentence as ``raw``, 0 where none is active."""
    a = F.when(active, value)
    return items.groupBy(*keys).agg(F.coalesce(F.avg(a), F.lit(0.0)).alias("raw"), F.count(a).alias("active_items"))


def positive_weights(items: DataFrame, batch: list[str], sentence: str, score: str, gamma: float = 1.0, gate: str | None = None) -> DataFrame:
    """Weights from the mean of max(score, 0)^gamma; a gate lets only items above zero count."""
    active = F.col(score).isNotNull() if gate is None else F.col(score).isNotNull() & (F.col(gate) > 0)
    raw = sentence_scores(items, [*batch, sentence], F.pow(F.greatest(F.col(score), F.lit(0.0)), F.lit(gamma)), active)
    return floor_and_normalise(raw, batch, F.col("raw") > 0)


def fisher_information(a: Column, p: Column) -> Column:
    return a * a * p * (1 - p)


def fisher_weights(items: DataFrame, batch: list[str], sentence: str, information: str) -> DataFrame:
    """Weights from mean item information; only sentences without items take the floor."""
    raw = sentence_scores(items, [*batch, sentence], F.col(information), F.col(information).isNotNull())
    return floor_and_normalise(raw, batch, F.col("active_items") > 0)


def variant_weights(items: DataFrame, batch: list[str], sentence: str, information: str, gate: str, u: str) -> DataFrame:
    """V0 all items, V1 gated items, V2 gated and times max(u, 0); one row per variant and sentence."""
    variants = F.explode(F.array(F.lit("V0"), F.lit("V1"), F.lit("V2")))
    x = items.withColumn("variant", variants)
    active = F.col(information).isNotNull() & ((F.col("variant") == "V0") | (F.col(gate) > 0))
    value = F.when(F.col("variant") == "V2", F.col(information) * F.greatest(F.col(u), F.lit(0.0))).otherwise(F.col(information))
    raw = sentence_scores(x, ["variant", *batch, sentence], value, active)
    return floor_and_normalise(raw, ["variant", *batch], F.col("raw") > 0)


def variant_grid(spark, scores=("u_oof", "u_min"), warmups=(0, 500), gated=(False, True)) -> DataFrame:
    """All variant names; a fixed parameter table."""
    rows = [(g, s, w, d, f"direct_{'gated' if d else 'plain'}_g{g:g}_{s}_w{w}") for g in GAMMAS for s in scores for w in warmups for d in gated]
    return spark.createDataFrame(rows, "gamma double, score string, warmup int, gated boolean, variant string")


def soft_response(u: Column, tau: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-u / tau))


def restricted_observation(scored: DataFrame, key: str, score: str, position: str, is_target: str) -> DataFrame:
    """Renormalised target probability over the candidates and whether the target wins (first position on ties)."""
    top = scored.groupBy(key).agg(F.max(score).alias("_m"))
    j = scored.join(top, key).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    best = F.max_by(F.col(is_target), F.struct(F.col(score), -F.col(position)))
    return j.groupBy(key).agg(best.cast("int").alias("hit"), (F.sum(F.when(F.col(is_target), F.col("_e"))) / F.sum("_e")).alias("target_probability"))


def easiness_weights(df: DataFrame, batch: list[str], sentence: str, c: str, epsilon: float = EPSILON) -> DataFrame:
    m = df.groupBy(*batch, sentence).agg(F.avg(c).alias("_c"))
    t = m.groupBy(*batch).agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return _by(batch, m, t).select(*batch, sentence, (F.col("_n") * F.col("_c") / (F.col("_t") + epsilon)).alias("weight"))


def warm_up(weight: Column, step: Column, warmup: int) -> Column:
    return F.when(step < warmup, F.lit(1.0)).otherwise(weight)


def weighted_objective(df: DataFrame, loss: str, weight: str, measurement: Column, lam: float) -> DataFrame:
    return df.agg((F.avg(F.col(weight) * F.col(loss)) + F.lit(lam) * measurement).alias("objective"))


def contrastive_loss(pairs: DataFrame, batch: list[str], left: str, right: str, score: str, temperature: float) -> DataFrame:
    """Per-row symmetric in-batch contrastive loss from the scores of a batch's pairs.

    Batches have a fixed size, so the pair table is rows x batch size.
    """
    z = F.col(score) / temperature
    x = pairs.withColumn("_z", z)

    def side(key):
        m = x.groupBy(*batch, key).agg(F.max("_z").alias("_m"))
        j = x.join(m, [*batch, key])
        own = F.max(F.when(F.col(left) == F.col(right), F.col("_z") - F.col("_m")))
        return j.groupBy(*batch, key).agg((F.log(F.sum(F.exp(F.col("_z") - F.col("_m")))) - own).alias("_l")).withColumnRenamed(key, "row")

    a, b = side(left), side(right)
    return a.join(b.withColumnRenamed("_l", "_r"), [*batch, "row"]).select(*batch, "row", ((F.col("_l") + F.col("_r")) / 2).alias("loss"))
