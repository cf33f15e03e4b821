"""Fold-keyed fits against plain numpy fits of each fold, with missing values, absent classes, ties and empty tables."""

import hashlib

import numpy as np
import pytest

from heldout.operators import fits

SHAPE = "id int, g int, y int, x array<double>"


def sample(n=120, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(3))
        rows.append((i, int(rng.integers(3)), y, [float(v) for v in rng.normal(size=2) + [y, -y]]))
    odd = [(900, None, 1, [1.0, 1.0]), (901, 1, None, [1.0, 1.0]), (902, 1, 1, None), (903, 1, 1, [float("nan"), 1.0]), (904, 1, 1, [None, 1.0]), (905, 0, 1, [])]
    return rows, odd


def plain_gradient(rows, model, fold):
    """Gradient of the balanced, penalised loss at the model, row by row."""
    train = [(y, x) for _, g, y, x in rows if g != fold]
    classes = sorted({y for y, _ in train})
    assert model["classes"] == classes and model["rows"] == len(train)
    grad = np.hstack([model["weights"][:, :-1], np.zeros((len(classes), 1))])
    for y, x in train:
        v = np.append(x, 1.0)
        e = np.exp(model["weights"] @ v)
        p = e / e.sum()
        p[classes.index(y)] -= 1
        grad = grad + len(train) / (len(classes) * sum(t == y for t, _ in train)) * np.outer(p, v)
    return np.abs(grad).max()


def test_logistic_folds(spark):
    rows, odd = sample()
    rows = [r for r in rows if not (r[2] == 2 and r[1] != 0)]  # class 2 lives in fold 0 only
    df = spark.createDataFrame(rows + odd, SHAPE)
    models = fits.fit_logistic_folds(df, "x", "y", "g")
    assert sorted(models) == [0, 1, 2] and models[0]["classes"] == [0, 1] and models[1]["classes"] == [0, 1, 2]
    for f, m in models.items():
        assert plain_gradient(rows, m, f) < 1e-7
        assert abs(m["weights"][:, -1].sum()) < 1e-9
    assert {r["g"]: r["gradient"] < 1e-7 for r in fits.logistic_gradients(df, models, "x", "y", "g").collect()} == {0: True, 1: True, 2: True}
    got = {r["id"]: r["prediction"] for r in fits.apply_logistic_folds(df, models, "x", "y", "g").collect()}
    for i, g, _, x in rows:
        m = models[g]
        assert got[i] == m["classes"][int((m["weights"] @ np.append(x, 1.0)).argmax())]
    assert all(got[i] is None for i in (900, 902, 903, 904, 905)) and got[901] is not None


def test_logistic_does_not_depend_on_partitions(spark):
    rows, _ = sample(60)
    a, b = (fits.fit_logistic_folds(spark.createDataFrame(r, SHAPE).repartition(n), "x", "y", "g") for r, n in ((rows, 1), (rows[::-1], 7)))
    assert all(np.allclose(a[f]["weights"], b[f]["weights"], atol=1e-8) for f in a)


def test_logistic_edges(spark):
    rows, _ = sample(30)
    assert fits.fit_logistic_folds(spark.createDataFrame([], SHAPE), "x", "y", "g") == {}
    one = spark.createDataFrame([(i, 0, y, x) for i, _, y, x in rows], SHAPE)
    models = fits.fit_logistic_folds(one, "x", "y", "g")
    assert models == {0: None}
    assert fits.apply_logistic_folds(one, models, "x", "y", "g").filter("prediction is not null").count() == 0
    with pytest.raises(ValueError, match="length"):
        fits.fit_logistic_folds(spark.createDataFrame([(1, 0, 0, [1.0]), (2, 1, 1, [1.0, 2.0])], SHAPE), "x", "y", "g")
    apart = spark.createDataFrame([(i, i % 2, int(i >= 10), [float(i >= 10)]) for i in range(20)] * 3, SHAPE)  # separable, repeated rows
    assert all(m["gradient"] <= 1e-8 for m in fits.fit_logistic_folds(apart, "x", "y", "g").values())


def plain_clusters(rows, fold, k, seed):
    train = sorted((str(i), np.array(x)) for i, g, _, x in rows if g != fold)
    centres = []
    for j in range(k):
        best = None
        for i, x in train:
            u = (int(hashlib.sha256(f"{seed}|{j}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            far = min(((x - c) ** 2).sum() for c in centres) if centres else 1.0
            if far and (best is None or -np.log(u) / far < best[0]):
                best = (-np.log(u) / far, x)
        if best:
            centres.append(best[1])
    for _ in range(100):
        near = [min(range(len(centres)), key=lambda c: ((x - centres[c]) ** 2).sum()) for _, x in train]
        centres = [np.mean([x for (_, x), n in zip(train, near) if n == c], axis=0) if c in near else centres[c] for c in range(len(centres))]
    return np.array(centres)


def test_clusters(spark):
    rows, odd = sample()
    df = spark.createDataFrame(rows + odd, SHAPE)
    centres = fits.fit_clusters(df.drop("y"), "id", "x", "g", k=4, seed=7)
    again = fits.fit_clusters(spark.createDataFrame((odd + rows)[::-1], SHAPE).repartition(5), "id", "x", "g", k=4, seed=7)
    assert sorted(centres) == [0, 1, 2]
    for f, c in centres.items():
        clean = rows + [(901, 1, None, [1.0, 1.0])]
        assert np.allclose(c, plain_clusters(clean, f, 4, 7), atol=1e-7)
        assert np.array_equal(c, again[f])  # to the last bit
    got = {r["id"]: r["cluster"] for r in fits.assign_clusters(df, centres, "x", "g").collect()}
    for i, g, _, x in rows:
        assert got[i] == int(((centres[g] - np.array(x)) ** 2).sum(axis=1).argmin())
    assert all(got[i] is None for i in (900, 902, 903, 904, 905))


def test_cluster_edges(spark):
    same = spark.createDataFrame([(i, 0, 0, [float(i % 3), 0.0]) for i in range(30)], SHAPE)
    centres = fits.fit_clusters(same, "id", "x", k=8)
    assert sorted(c[0] for c in centres[None]) == pytest.approx([0, 1, 2])
    assert fits.assign_clusters(same, centres, "x").select("cluster").distinct().count() == 3
    assert len(fits.fit_clusters(spark.createDataFrame([], SHAPE), "id", "x")[None]) == 0
    assert len(fits.fit_clusters(spark.createDataFrame([(1, 0, 0, [0.0])], SHAPE), "id", "x")[None]) == 1


def plain_item(q, y):
    a, c = np.log(2.0), 0.0
    n = len(q)
    for _ in range(20000):  # plain projected descent
        p = 1 / (1 + np.exp(-(a * q + c)))
        ga = ((p - y) * q).sum() + 2e-3 * n * a
        gc = (p - y).sum() + 1e-5 * n * c
        a, c = min(max(a - ga / n, 1e-3), 5.0), c - gc / n
    return a, c


def test_two_parameters_against_descent(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, slope in enumerate([1.5, -0.7, 0.9]):  # the second one ends at the lower bound
        q = rng.normal(size=400)
        y = (rng.random(400) < 1 / (1 + np.exp(-(slope * q + 0.3)))).astype(float)
        rows += [(k, float(a), float(b)) for a, b in zip(q, y)]
        want[k] = plain_item(q, y)
    odd = [(None, 0.1, 1.0), (0, None, 1.0), (0, float("nan"), 0.0), (0, float("inf"), 0.0), (1, 0.2, None)]
    got = {r["i"]: r for r in fits.fit_two_parameter(spark.createDataFrame(rows + odd, "i int, q double, y double"), "i", "q", "y").collect()}
    assert sorted(got) == [0, 1, 2] and got[1]["a"] == pytest.approx(1e-3)
    for k, (a, c) in want.items():
        assert got[k]["a"] == pytest.approx(a, abs=1e-5) and -got[k]["a"] * got[k]["b"] == pytest.approx(c, abs=1e-4)
        assert got[k]["responses"] == 400 and got[k]["gradient"] <= 1e-9
    assert fits.fit_two_parameter(spark.createDataFrame([], "i int, q double, y double"), "i", "q", "y").count() == 0


def test_hot_item_is_a_bounded_row(spark):
    from pyspark.sql import functions as F

    df = spark.range(400_000).select(F.lit(1).alias("i"), (F.randn(5) * 2).alias("q"), F.rand(6).alias("u"))
    df = df.withColumn("y", F.when(F.col("u") < 1 / (1 + F.exp(-1.2 * (F.col("q") - 0.5))), 1.0).otherwise(0.0))
    r = fits.fit_two_parameter(df, "i", "q", "y").first()
    assert r["cells"] < 7000 and r["responses"] == 400_000 and r["gradient"] <= 1e-10
    c = -r["a"] * r["b"]
    p = 1 / (1 + F.exp(-(r["a"] * F.col("q") + c)))
    true = df.agg(F.avg((p - F.col("y")) * F.col("q")), F.avg(p - F.col("y"))).first()  # over the responses themselves
    assert abs(true[0] + 2e-3 * r["a"]) < 1e-6 and abs(true[1] + 1e-5 * c) < 1e-6


def test_extreme_abilities(spark):
    rows = [(1, v, float(v > 0)) for v in (-1e6, -5.0, 0.0, 5.0, 1e6)] + [(2, 0.5, 1.0)] * 3
    got = {r["i"]: r for r in fits.fit_two_parameter(spark.createDataFrame(rows, "i int, q double, y double"), "i", "q", "y").collect()}
    assert all(1e-3 <= r["a"] <= 5.0 and np.isfinite(r["b"]) for r in got.values())


def test_item_clusters_stop_where_their_sql_does(monkeypatch, spark):
    """Larger tables need more than the 80 Lloyd steps of the SQL to come to rest (86 and more); the query must not go on."""
    from heldout.plans import feature_queries as fq
    from heldout.plans.registry import Tables

    class Seen(Exception):
        pass

    def fit(*_, steps=None, **__):
        raise Seen(steps)

    monkeypatch.setattr(fq.fits, "fit_clusters", fit)
    with pytest.raises(Seen) as seen:
        fq.item_clusters(Tables(spark, "/root/testdata/sf0.001"))
    assert seen.value.args == (80,)
