"""Fold-keyed fits: every fold's model in the same passes, each fitted on the rows outside its fold.

A pass streams the written rows once and returns sums whose size depends on the
models only. Parameters live on the driver; their number is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from .durable import durable

#: Most parameters of one logistic model: its curvature is a square of that side on the driver.
LARGEST_MODEL = 4096
#: Responses whose asinh(q) fall into the same of these parts of a unit share a cell.
CELLS = 1024


def _finite(vector: str):
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad, F.lit(False))


def _streams(df: DataFrame) -> DataFrame:
    """As many tasks as cores, so that a pass leaves one set of sums per core, not per file split."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


# ---- class-balanced multinomial logistic regression ----

def fit_logistic_folds(df: DataFrame, vector: str, label: str, fold: str, penalty: float = 1.0, steps: int = 60, tolerance: float = 1e-8) -> dict:
    """One model per value of ``fold``, fitted on all other folds' rows, by damped Newton steps.

    Minimises the class-balanced log loss (row weight n / (classes * class size))
    plus penalty / 2 times the squared weights; intercepts are free and sum to
    zero. All folds share each pass over the rows: per task and fold it sums
    loss, gradient and the upper blocks of the curvature, and the sums meet
    under (fold, block). A step that does not lower the loss is halved.

    Rows with a NULL label or fold, or a vector that is empty, NULL or not
    finite, take no part. A class without training rows is unknown to that
    fold's model. With a single fold there is nothing to fit on and the model
    is None. Returns {fold: {"classes", "weights" (classes x (dims + 1), intercept
    last), "loss", "gradient" (largest absolute entry), "rows"}}.
    """
    rows = durable(df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull() & _finite(vector)).select(
        F.col(fold).alias("g"), F.col(label).alias("y"), F.col(vector).cast("array<double>").alias("x")))
    sizes = rows.groupBy("g", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).limit(LARGEST_MODEL + 1).toPandas()
    if sizes.empty:
        return {}
    if len(sizes) > LARGEST_MODEL:
        raise ValueError(f"more than {LARGEST_MODEL} pairs of fold and class")
    width = int(sizes["hi"].max()) + 1
    if sizes["lo"].min() + 1 != width:
        raise ValueError("vectors differ in length")
    folds, classes = sorted(sizes["g"].unique().tolist()), sorted(sizes["y"].unique().tolist())
    if len(classes) * width > LARGEST_MODEL:
        raise ValueError(f"{len(classes)} classes of {width} parameters exceed {LARGEST_MODEL}")
    count = np.zeros((len(folds), len(classes)))
    for r in sizes.itertuples(index=False):
        count[folds.index(r.g), classes.index(r.y)] = r.n
    fit_rows = count.sum(axis=0)[None, :] - count
    live = [np.flatnonzero(c) for c in fit_rows]
    weight = [c.sum() / (np.count_nonzero(c) * np.maximum(c, 1)) if c.sum() else c for c in fit_rows]
    state = {i: {"at": None, "loss": np.inf, "trial": np.zeros((len(live[i]), width)), "open": True} for i in range(len(folds)) if len(live[i])}
    stream = _streams(rows)
    for _ in range(steps):
        trial = {i: s["trial"] for i, s in state.items() if s["open"]}
        if not trial:
            break
        sums = _logistic_sums(stream, trial, folds, classes, live, weight)
        for i, (loss, grad, curve) in sums.items():
            s = state[i]
            theta = s["trial"]
            loss += penalty / 2 * float((theta[:, :-1] ** 2).sum())
            if not loss <= s["loss"] + 1e-12 * max(1.0, abs(s["loss"])) and s["at"] is not None:
                s["trial"] = (s["at"] + theta) / 2
                s["open"] = bool(np.abs(s["trial"] - s["at"]).max() > 1e-14)
                continue
            grad = grad + penalty * np.hstack([theta[:, :-1], np.zeros((len(theta), 1))])
            s.update(at=theta, loss=loss, gradient=float(np.abs(grad).max()))
            s["open"] = s["gradient"] > tolerance
            if s["open"]:
                ridge = np.tile(np.append(np.full(width - 1, penalty), 0.0), len(theta))
                free = np.tile(np.append(np.zeros(width - 1), 1.0), len(theta))  # intercepts move by no common shift
                s["trial"] = theta - np.linalg.solve(curve + np.diag(ridge) + np.outer(free, free), grad.ravel()).reshape(theta.shape)
    return {f: None if i not in state else {"classes": [classes[c] for c in live[i]], "weights": state[i]["at"], "loss": state[i]["loss"], "gradient": state[i]["gradient"],
                                            "rows": int(fit_rows[i].sum())} for i, f in enumerate(folds)}


def _logistic_sums(rows: DataFrame, trial: dict, folds: list, classes: list, live: list, weight: list) -> dict:
    """{fold number: (loss, gradient, curvature)} at the trial parameters."""
    width = next(iter(trial.values())).shape[1]
    fold_at, class_at = {f: i for i, f in enumerate(folds)}, {c: i for i, c in enumerate(classes)}

    def partial(batches):
        acc: dict = {}
        for b in batches:
            if b.empty:
                continue
            x = np.column_stack([np.stack(b["x"].to_numpy()), np.ones(len(b))])
            g, y = b["g"].map(fold_at).to_numpy(), b["y"].map(class_at).to_numpy()
            for i, theta in trial.items():
                rest = g != i
                xi, yi = x[rest], np.searchsorted(live[i], y[rest])
                if not len(xi):
                    continue
                z = xi @ theta.T
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                mass = p.sum(axis=1)
                p /= mass[:, None]
                w = weight[i][y[rest]]
                mine = np.arange(len(yi))
                loss = float((w * (np.log(mass) - z[mine, yi])).sum())
                r = p.copy()
                r[mine, yi] -= 1
                parts = {-1: np.append(((w[:, None] * r).T @ xi).ravel(), loss)}
                k = len(theta)
                for a in range(k):
                    for c in range(a, k):
                        v = w * p[:, a] * ((a == c) - p[:, c])
                        parts[a * k + c] = ((xi * v[:, None]).T @ xi).ravel()
                for block, v in parts.items():
                    acc[i, block] = acc[i, block] + v if (i, block) in acc else v
        if acc:
            yield pd.DataFrame({"m": [i for i, _ in acc], "block": [c for _, c in acc], "v": list(acc.values())})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": pdf["m"].iloc[:1], "block": pdf["block"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    shape = "m int, block int, v array<double>"
    # one row per task in a group; the totals are as large as the models
    sums = rows.mapInPandas(partial, shape).groupBy("m", "block").applyInPandas(total, shape).toPandas()
    out = {}
    for i, part in sums.groupby("m"):
        k = len(trial[i])
        curve = np.zeros((k * width, k * width))
        for block, v in zip(part["block"], part["v"]):
            if block == -1:
                grad, loss = np.asarray(v[:-1]).reshape(k, width), float(v[-1])
                continue
            a, c = divmod(block, k)
            square = np.asarray(v).reshape(width, width)
            curve[a * width:(a + 1) * width, c * width:(c + 1) * width] = square
            curve[c * width:(c + 1) * width, a * width:(a + 1) * width] = square.T
        out[i] = loss, grad, curve
    return out


def item_fold_validation(df: DataFrame, vector: str, label: str, fold: str) -> DataFrame:
    """Pooled predictions where each item fold is predicted by a model of the others."""
    return apply_logistic_folds(df, fit_logistic_folds(df, vector, label, fold), vector, label, fold)


def apply_logistic_folds(df: DataFrame, models: dict, vector: str, label: str, fold: str, out: str = "prediction") -> DataFrame:
    """Each row's class by the model that never saw its fold; NULL without a model or a usable vector. Ties go to the smaller class."""
    kind = df.schema[label].dataType
    known = {f: m for f, m in models.items() if m}

    @F.pandas_udf(kind)
    def predict(x: pd.Series, g: pd.Series) -> pd.Series:
        answer = np.full(len(x), None, dtype=object)
        for f, m in known.items():
            at = np.flatnonzero((g == f).fillna(False).to_numpy(dtype=bool) & x.notna().to_numpy())
            if len(at):
                z = np.stack(x.iloc[at].to_numpy()) @ m["weights"][:, :-1].T + m["weights"][:, -1]
                answer[at] = [m["classes"][c] for c in z.argmax(axis=1)]
        return pd.Series(answer)

    usable = F.when(_finite(vector), F.col(vector).cast("array<double>"))
    return df.withColumn(out, predict(usable, F.col(fold)))


def logistic_gradients(df: DataFrame, models: dict, vector: str, label: str, fold: str, penalty: float = 1.0) -> DataFrame:
    """(fold, fit_rows, classes, gradient) of fitted models, taken anew by column expressions over all rows: a proof of the fit."""
    spark = df.sparkSession
    known = {f: m for f, m in models.items() if m}
    g, y = df.schema[fold].dataType.simpleString(), df.schema[label].dataType.simpleString()
    table = spark.createDataFrame([(f, m["classes"], m["weights"].tolist()) for f, m in known.items()], f"_g {g}, _classes array<{y}>, _w array<array<double>>")
    x = F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0)))
    rows = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull() & _finite(vector)).select(F.col(fold).alias("_f"), F.col(label).alias("_y"), x.alias("_x"))
    rows = rows.withColumn("_g", F.explode(F.array(*[F.lit(f).cast(g) for f in known]))).filter("_f <> _g")
    sizes = rows.groupBy("_g", "_y").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy("_g").agg(F.sum("_n").alias("fit_rows"), F.count(F.lit(1)).alias("classes"))
    weight = sizes.join(totals, "_g").select("_g", "_y", (F.col("fit_rows") / (F.col("classes") * F.col("_n"))).alias("_b"))
    # size bound of both tables: folds x classes, checked when the models were fitted
    met = rows.join(F.broadcast(table), "_g").join(F.broadcast(weight), ["_g", "_y"])
    met = met.withColumn("_z", F.transform("_w", lambda w: F.aggregate(F.zip_with(w, "_x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    met = met.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    met = met.withColumn("_mass", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    lean = F.zip_with("_e", "_classes", lambda e, c: F.col("_b") * (e / F.col("_mass") - F.when(c == F.col("_y"), 1.0).otherwise(0.0)))
    cells = met.select("_g", "_x", F.posexplode(lean).alias("_c", "_r")).select("_g", "_c", "_r", F.posexplode("_x").alias("_i", "_v"))
    sums = cells.groupBy("_g", "_c", "_i").agg(F.sum(F.col("_r") * F.col("_v")).alias("_s"))
    held = F.when(F.col("_i") < F.size(F.col("_w")[0]) - 1, penalty * F.col("_w")[F.col("_c")][F.col("_i")]).otherwise(0.0)
    worst = sums.join(F.broadcast(table), "_g").groupBy("_g").agg(F.max(F.abs(F.col("_s") + held)).alias("gradient"))
    return worst.join(totals, "_g").select(F.col("_g").alias(fold), "fit_rows", "classes", "gradient")


# ---- clusters ----

def fit_clusters(df: DataFrame, row: str, vector: str, fold: str | None = None, k: int = 8, seed: int = 20260813, steps: int = 300) -> dict:
    """K-means centres per fold, fitted on the rows outside the fold (on all rows without ``fold``).

    Starting points: point j is the row with the smallest -ln(u) / D2, where u
    comes from the hash of (seed, j, row) and D2 is the squared distance to the
    nearest point so far (1 for the first); that is a draw in proportion to D2.
    Equal rows draw alike, ties go to the smaller row id. Then Lloyd steps until
    no centre moves. Components are summed as whole multiples of 2^-30 of the
    largest one, so centres depend neither on row order nor on partitions. A
    cluster that loses all rows keeps its centre; with fewer than k distinct
    vectors there are fewer centres. Unusable vectors and NULL folds take no
    part. Returns {fold: centres}, with the key None when ``fold`` is None.
    """
    uniform = F.array(*[(F.conv(F.substring(sha256(F.lit(seed), F.lit(j), F.col(row)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for j in range(k)])
    g = F.col(fold) if fold else F.lit(None).cast("int")
    rows = df.filter(_finite(vector) & (F.col(fold).isNotNull() if fold else F.lit(True)))
    rows = durable(rows.select(F.col(row).cast("string").alias("id"), g.alias("g"), F.col(vector).cast("array<double>").alias("x"), uniform.alias("u")))
    folds = sorted(r[0] for r in rows.select("g").distinct().collect()) if fold else [None]
    facts = rows.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("top"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if facts["top"] is None:
        return {f: np.zeros((0, 0)) for f in folds}
    if facts["lo"] != facts["hi"]:
        raise ValueError("vectors differ in length")
    unit = (facts["top"] or 1.0) / (1 << 30)
    stream = _streams(rows)
    centres: dict = {f: np.zeros((0, facts["hi"])) for f in folds}
    for j in range(k):
        for r in _seed_candidates(stream, centres, j).groupBy("m").agg(F.min_by("x", F.struct("key", "id")).alias("x")).collect():
            centres[folds[r["m"]]] = np.vstack([centres[folds[r["m"]]], r["x"]])
    for _ in range(steps):
        sums = _cluster_sums(stream, centres, unit).groupBy("m", "c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()  # models x k x dims rows
        fresh = {f: c.copy() for f, c in centres.items()}
        for m, c, i, s, n in sums.itertuples(index=False):
            fresh[folds[m]][c, i] = float(s) * unit / n
        still = all(np.array_equal(fresh[f], centres[f]) for f in folds)
        centres = fresh
        if still:
            break
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; each is summed on its own, so its bits do not depend on the batch."""
    return np.column_stack([((x - c) ** 2).sum(axis=1) for c in centres])


def _batch(b: pd.DataFrame, folds: list):
    if b.empty:
        return
    x = np.stack(b["x"].to_numpy())
    for m, f in enumerate(folds):
        rest = np.ones(len(b), bool) if f is None else (b["g"] != f).to_numpy()
        if rest.any():
            yield m, f, x[rest], rest


def _seed_candidates(rows: DataFrame, centres: dict, j: int) -> DataFrame:
    """Per task and model: the row with the smallest key."""
    folds = list(centres)

    def best(batches):
        top: dict = {}
        for b in batches:
            u = np.array([v[j] for v in b["u"]])
            for m, f, x, rest in _batch(b, folds):
                far = _distances(x, centres[f]).min(axis=1) if j and len(centres[f]) else np.ones(len(x)) * (j == 0)
                ids = b["id"].to_numpy()[rest]
                with np.errstate(divide="ignore"):
                    key = -np.log(u[rest]) / far
                low = key.min()
                if np.isfinite(low):
                    at = min(np.flatnonzero(key == low), key=lambda n: str(ids[n]))
                    found = (float(low), str(ids[at]), x[at])
                    if m not in top or found[:2] < top[m][:2]:
                        top[m] = found
        if top:
            yield pd.DataFrame({"m": list(top), "key": [v[0] for v in top.values()], "id": [v[1] for v in top.values()], "x": [v[2] for v in top.values()]})

    return rows.mapInPandas(best, "m int, key double, id string, x array<double>")


def _cluster_sums(rows: DataFrame, centres: dict, unit: float) -> DataFrame:
    """Per task, model, cluster and component: whole-number sum and rows."""
    folds = list(centres)

    def partial(batches):
        acc: dict = {}
        for b in batches:
            for m, f, x, _ in _batch(b, folds):
                if not len(centres[f]):
                    continue
                near = _distances(x, centres[f]).argmin(axis=1)
                whole = np.rint(x / unit).astype(np.int64)
                for c in np.unique(near):
                    mine = whole[near == c]
                    s, n = acc.get((m, c), (0, 0))
                    acc[m, c] = s + mine.sum(axis=0), n + len(mine)
        if acc:
            yield pd.DataFrame({"m": [m for m, _ in acc], "c": [c for _, c in acc], "s": [s for s, _ in acc.values()], "n": [n for _, n in acc.values()]})

    sums = rows.mapInPandas(partial, "m int, c int, s array<bigint>, n bigint")
    return sums.select("m", "c", "n", F.posexplode("s").alias("i", "s")).withColumn("s", F.col("s").cast("decimal(38,0)"))


def assign_clusters(df: DataFrame, centres: dict, vector: str, fold=None, out: str = "cluster") -> DataFrame:
    """Nearest centre of the model named by ``fold`` (a column name; None for the single model); NULL without one."""
    @F.pandas_udf("int")
    def nearest(x: pd.Series, g: pd.Series) -> pd.Series:
        answer = np.full(len(x), None, dtype=object)
        for f, c in centres.items():
            mine = np.ones(len(x), bool) if f is None else (g == f).fillna(False).to_numpy(dtype=bool)
            at = np.flatnonzero(mine & x.notna().to_numpy())
            if len(at) and len(c):
                answer[at] = _distances(np.stack(x.iloc[at].to_numpy()), c).argmin(axis=1)
        return pd.Series(answer)

    usable = F.when(_finite(vector), F.col(vector).cast("array<double>"))
    return df.withColumn(out, nearest(usable, F.col(fold) if fold else F.lit(None).cast("int")))


# ---- two-parameter items ----

def fit_two_parameter(df: DataFrame, item: str, q: str, y: str, steps: int = 200, penalty: float = 1e-3, a_max: float = 5.0, tolerance: float = 1e-10) -> DataFrame:
    """Discrimination ``a`` and difficulty ``b`` of every item, with responses, cells and the largest gradient per response.

    Minimises log loss + penalty * n * a^2 + penalty / 200 * n * c^2 over
    0.001 <= a <= a_max, where c = -a * b. One aggregation turns the responses
    of an item into cells of asinh(q): count, mean and variance of q, and the
    exact sums of y and y * q. An item's cells are one row, however many
    responses it has (fewer than 1.5 million cells for any doubles, some
    thousands in practice), and all its steps run there without a shuffle.
    A cell of equal q is exact; otherwise the curvature enters through the
    variance, and the loss errs by at most 0.1 * (a * h)^3 / 6 per response, with
    h = sqrt(1 + q^2) / 1024 the width of the cell.

    NULL or non-finite q, NULL y and NULL items take no part. An empty table gives no rows.
    Abilities beyond about 1e6 cost the other responses of their item precision.
    """
    ok = F.col(item).isNotNull() & F.col(y).isNotNull() & F.col(q).isNotNull() & ~F.isnan(q) & (F.abs(q) != float("inf"))
    v, t = F.col(q).cast("double"), F.col(y).cast("double")
    cells = df.filter(ok).groupBy(F.col(item).alias("i"), F.floor(F.asinh(v) * CELLS).alias("k")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"), F.sum(t).alias("t"), F.sum(t * v).alias("tq"))
    packed = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "n", "m", "s", "t", "tq"))).alias("c"))
    packed = packed.select("i", *[F.col("c")[f].alias(f) for f in ("n", "m", "s", "t", "tq")])

    def solve(batches):
        for b in batches:
            done = [_two_parameters(*[np.asarray(r[f]) for f in ("n", "m", "s", "t", "tq")], steps, penalty, a_max, tolerance) for r in b.to_dict("records")]
            yield pd.DataFrame({item: b["i"], "a": [d[0] for d in done], "b": [-d[1] / d[0] for d in done], "responses": [int(n.sum()) for n in b["n"]],
                                "cells": [len(n) for n in b["n"]], "gradient": [d[2] for d in done]})

    kind = df.schema[item].dataType.simpleString()
    return packed.mapInPandas(solve, f"`{item}` {kind}, a double, b double, responses long, cells long, gradient double")


def _two_parameters(n, m, s, t, tq, steps, penalty, a_max, tolerance):
    """(a, c, largest gradient per response) of one item from its cells."""
    total, right, lean = n.sum(), t.sum(), tq.sum()

    def look(a, c):
        z = a * m + c
        p = 0.5 * (1 + np.tanh(z / 2))
        w = p * (1 - p)
        bend = 0.5 * a * a * n * s * w
        loss = (n * np.logaddexp(0, z) + bend).sum() - a * lean - c * right + penalty * total * (a * a + c * c / 200)
        tilt = n * p + bend * (1 - 2 * p)
        ga = (tilt * m + a * n * s * w).sum() - lean + 2 * penalty * total * a
        gc = tilt.sum() - right + penalty * total * c / 100
        root = np.sqrt(n * w)  # far out the weight is 0, while m * m may overflow
        aa, ac = ((root * m) ** 2 + n * w * s).sum() + 2 * penalty * total, (root * (root * m)).sum()
        h = np.array([[aa, ac], [ac, (n * w).sum() + penalty * total / 100]])
        return loss, np.array([ga, gc]), h

    a, c = np.log(2.0), 0.0
    loss, g, h = look(a, c)
    for _ in range(steps):
        held = (a <= 1e-3 and g[0] > 0) or (a >= a_max and g[0] < 0)
        worst = (abs(g[1]) if held else np.abs(g).max()) / total
        if worst <= tolerance:
            break
        step = np.array([0.0, g[1] / h[1, 1]]) if held else np.linalg.solve(h, g)
        step = np.clip(step, -2, 2)
        for _ in range(60):
            x, y = min(max(a - step[0], 1e-3), a_max), c - step[1]
            fresh = look(x, y)
            if fresh[0] <= loss + 1e-13 * abs(loss) or np.abs(step).max() < 1e-12:
                break
            step = step / 2
        a, c, (loss, g, h) = x, y, fresh
    held = (a <= 1e-3 and g[0] > 0) or (a >= a_max and g[0] < 0)
    return a, c, float((abs(g[1]) if held else np.abs(g).max()) / total)
