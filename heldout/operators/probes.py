"""Linear probes fitted from distributed moments, and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from .durable import durable, small
from .splits import cell_roles


def moments(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Sums over [1, x, y] times [1, x, y] per group, as (group, i, j, v) with i <= j.

    Each task adds its rows up with one matrix product per batch and group, so
    what is shuffled depends on the model size, not on the rows.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema.fields)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            parts = pdf.groupby(group, sort=False, dropna=False) if group else [((), pdf)]
            for name, part in parts:
                z = np.hstack([np.ones((len(part), 1)), np.vstack(part[x].to_numpy()).astype(float), np.vstack(part[y].to_numpy()).astype(float)])
                if not np.isfinite(z).all():
                    raise ValueError("probe inputs must be finite")
                sums[name] = sums.get(name, 0.0) + z.T @ z
        for name, m in sums.items():
            i, j = np.triu_indices(m.shape[0])
            cols = {g: [v] * len(i) for g, v in zip(group, name if isinstance(name, tuple) else (name,))}
            yield pd.DataFrame({**cols, "i": i, "j": j, "v": m[i, j]})

    part = df.select(*group, x, y).mapInPandas(partial, (fields + ", " if fields else "") + "i int, j int, v double")
    return part.groupBy(*group, "i", "j").agg(F.sum("v").alias("v"))


def train_moments(m: DataFrame, ks: int, kt: int, sf: str, tf: str) -> DataFrame:
    """Moments of each cell's train part from the moments of the ks x kt fold blocks."""
    keep = [c for c in m.columns if c not in (sf, tf, "v")]
    return cell_roles(m, ks, kt, sf, tf).filter("role = 'train'").groupBy("cell_subject", "cell_text", *keep).agg(F.sum("v").alias("v"))


def solve_ridge(m: DataFrame, group: list[str], d: int, alpha: float = 1.0) -> DataFrame:
    """Weights (one array per output) and intercepts per group; the intercept is not penalised.

    A group's input here is one moment matrix, whose size is set by the model.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.select(*group).schema.fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["j"].max()) + 1
        a = np.zeros((k, k))
        a[pdf["i"], pdf["j"]] = pdf["v"]
        a = np.triu(a) + np.triu(a, 1).T
        n = a[0, 0]
        mean = a[0] / n
        centred = a - n * np.outer(mean, mean)
        w = np.linalg.solve(centred[1:d + 1, 1:d + 1] + alpha * np.eye(d), centred[1:d + 1, d + 1:])
        b = mean[d + 1:] - mean[1:d + 1] @ w
        return pd.DataFrame([[*[pdf[g].iloc[0] for g in group], int(n), w.T.tolist(), b.tolist()]], columns=[*group, "fit_rows", "weights", "intercept"])

    return m.groupBy(*group).applyInPandas(solve, (fields + ", " if fields else "") + "fit_rows long, weights array<array<double>>, intercept array<double>")


def predict(df: DataFrame, models: DataFrame, on: list[str], x: str, out: str = "prediction") -> DataFrame:
    """Linear predictions with the model of each row's group."""
    joined = df.join(small(models.drop("fit_rows"), 10_000), on)
    value = F.zip_with("weights", "intercept", lambda w, b: dot(w, F.col(x)) + b)
    return joined.withColumn(out, value).drop("weights", "intercept")


def cross_fit(df: DataFrame, x: str, y: str, d: int, ks: int, kt: int, sf: str, tf: str, alpha: float = 1.0, arms=()) -> DataFrame:
    """Each row predicted once by a model that saw neither its entity fold nor its item fold.

    One pass collects fold-block moments; every cell's model comes from sums of them.
    """
    arms = list(arms)
    m = moments(df, [*arms, sf, tf], x, y)
    models = solve_ridge(train_moments(m, ks, kt, sf, tf), ["cell_subject", "cell_text", *arms], d, alpha)
    models = models.withColumnRenamed("cell_subject", sf).withColumnRenamed("cell_text", tf)
    return predict(df, models, [*arms, sf, tf], x)


def log_probability(scored: DataFrame, keys: list[str], score: str, is_target: str, temperature: float = 0.07) -> DataFrame:
    """Log-softmax of the target's score among its candidates."""
    z = F.col(score) / F.lit(temperature)
    top = scored.groupBy(*keys).agg(F.max(z).alias("_m"))
    e = scored.join(top, keys)
    return e.groupBy(*keys).agg(
        (F.max(F.when(F.col(is_target), z - F.col("_m"))) - F.log(F.sum(F.exp(z - F.col("_m"))))).alias("log_probability"))


def score_vocabulary(df: DataFrame, row: str, query: str, truth: str, vocabulary: DataFrame, item: str, vector: str, temperature: float = 0.07, block: int = 1024) -> DataFrame:
    """Log-probability of the true item and the best item under cosine logits over a whole vocabulary.

    The vocabulary is packed into blocks of bounded size; each row meets each
    block once and leaves one partial sum there. Ties go to the smaller item.
    """
    n = vocabulary.count()
    blocks = max(1, -(-n // block))
    packed = vocabulary.select(F.pmod(F.xxhash64(item), F.lit(blocks)).alias("_b"), F.struct(F.col(item).alias("k"), F.col(vector).alias("v")).alias("_s")) \
        .groupBy("_b").agg(F.collect_list("_s").alias("_items"))  # about ``block`` items each
    q = df.select(row, truth, unit(F.col(query)).alias("_q")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    logit = lambda s: dot(F.col("_q"), s["v"]) / F.lit(temperature)
    packed = durable(packed)
    if n <= 8 * block:  # a few blocks of bounded size
        met = q.join(F.broadcast(packed), "_b")
    else:  # few block numbers, many rows: spread each block over the tasks
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = q.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).join(copies, ["_b", "_salt"])
    scored = met.withColumn("_l", F.transform("_items", lambda s: F.struct(logit(s).alias("z"), s["k"].alias("k"))))
    peak = F.array_max(F.transform("_l", lambda s: s["z"]))
    part = scored.select(row, truth, "_l", peak.alias("_m")).select(
        row, truth, "_m",
        F.aggregate("_l", F.lit(0.0), lambda a, s: a + F.exp(s["z"] - F.col("_m"))).alias("_e"),
        F.array_max(F.transform(F.filter("_l", lambda s: s["k"] == F.col(truth)), lambda s: s["z"])).alias("_t"),
        F.array_min(F.transform(F.filter("_l", lambda s: s["z"] == F.col("_m")), lambda s: s["k"])).alias("_k"))
    top = part.groupBy(row, truth).agg(F.max("_m").alias("_top"), F.max("_t").alias("_true"), F.collect_list(F.struct("_m", "_e", "_k")).alias("_parts"))
    mass = F.aggregate("_parts", F.lit(0.0), lambda a, s: a + s["_e"] * F.exp(s["_m"] - F.col("_top")))
    best = F.array_min(F.transform(F.filter("_parts", lambda s: s["_m"] == F.col("_top")), lambda s: s["_k"]))
    return top.select(row, truth, (F.col("_true") - F.col("_top") - F.log(mass)).alias("log_probability"), best.alias("best_item"))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * class size) per row."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    table = sizes.join(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(out))  # one row
    return df.join(small(table), label)


def two_parameter_probability(q, a, b):
    """p = 1 / (1 + exp(-a (q - b)))."""
    return 1.0 / (1.0 + F.exp(-a * (q - b)))


# Fixed value: the reason of a role without registered inputs.
UNKNOWN_ROLE = "ROLE_NOT_REGISTERED"


def role_input(role: str, parts: dict[str, list[str]]):
    """Concatenated inputs registered for a role; NULL for any other role."""
    out = F.lit(None)
    for name, columns in parts.items():
        out = F.when(F.col(role) == name, F.concat(*[F.col(c) for c in columns])).otherwise(out)
    return out


def role_reason(role: str, parts: dict[str, list[str]]):
    """Why a row has no inputs; NULL if its role is registered."""
    return F.when(F.col(role).isin(list(parts)), None).otherwise(UNKNOWN_ROLE)


def require_roles(df: DataFrame, role: str, parts: dict[str, list[str]]) -> DataFrame:
    """``df`` unchanged; the job fails at the first row whose role is not registered."""
    broken = F.raise_error(F.concat(F.lit("no inputs are registered for the role "), F.coalesce(F.col(role), F.lit("NULL"))))
    return df.withColumn(role, F.when(role_reason(role, parts).isNull(), F.col(role)).otherwise(broken.cast(df.schema[role].dataType)))


def preflight(common_rows, all_rows, minimum: float = 0.5) -> DataFrame:
    """One row: common-support rate of a cell and whether the run may go on. No scores are read."""
    a = common_rows.agg(F.count(F.lit(1)).alias("common"))
    b = all_rows.agg(F.count(F.lit(1)).alias("total"))
    rate = F.col("common") / F.col("total")
    return a.join(F.broadcast(b)).select("common", "total", rate.alias("rate"),  # one row each
                                         F.when(F.col("total") == 0, "BLOCKED_EMPTY_CELL").when(rate < minimum, "BLOCKED_COMMON_SUPPORT").otherwise("PASS").alias("status"))
