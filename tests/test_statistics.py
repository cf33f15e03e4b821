"""Features, probes, statistics and weights against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heldout.operators import features as ft
from heldout.operators import fits
from heldout.operators import probes as pb
from heldout.operators import statistics as st
from heldout.operators import weights as wt


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 240
    return pd.DataFrame({"row": range(n), "e": [f"e{i % 12}" for i in range(n)], "sf": [i % 12 % 3 for i in range(n)], "tf": [i % 2 for i in range(n)],
                         "x": list(rng.normal(size=(n, 3)).round(6)), "y": list(rng.normal(size=(n, 2)).round(6)), "v": rng.gamma(1.0, size=n).round(2)})


def as_df(spark, frame):
    return spark.createDataFrame([tuple(r) for r in frame.assign(x=frame["x"].map(lambda a: a.tolist()), y=frame["y"].map(lambda a: a.tolist())).itertuples(index=False)],
                                 "row long, e string, sf int, tf int, x array<double>, y array<double>, v double")


def test_cross_fit_equals_ridge(spark, frame):
    got = pb.cross_fit(as_df(spark, frame), "x", "y", 3, 3, 2, "sf", "tf").toPandas().sort_values("row")
    x, y = np.vstack(frame["x"]), np.vstack(frame["y"])
    for s in range(3):
        for t in range(2):
            train = ((frame["sf"] != s) & (frame["tf"] != t)).to_numpy()
            test = ((frame["sf"] == s) & (frame["tf"] == t)).to_numpy()
            xm, ym = x[train].mean(0), y[train].mean(0)
            w = np.linalg.solve((x[train] - xm).T @ (x[train] - xm) + np.eye(3), (x[train] - xm).T @ (y[train] - ym))
            assert np.allclose(np.vstack(got["prediction"])[test], x[test] @ w + ym - xm @ w)


def test_robust_normaliser_never_sees_held_out_rows(spark, frame):
    df = as_df(spark, frame)
    state = ft.fit_robust(df.filter("sf <> 0"), ["tf"], "v")
    changed = ft.fit_robust(df.withColumn("v", F.when(F.col("sf") == 0, 1e9).otherwise(F.col("v"))).filter("sf <> 0"), ["tf"], "v")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, changed.collect()))
    for r in state.collect():
        a = frame[(frame["sf"] != 0) & (frame["tf"] == r["tf"])]["v"].to_numpy()
        lo, hi = np.quantile(a, [0.005, 0.995])
        c = np.clip(a, lo, hi)
        q1, q3 = np.quantile(c, [0.25, 0.75])
        assert np.allclose([r["lower"], r["upper"], r["median"], r["raw_iqr"]], [lo, hi, np.median(c), q3 - q1])


def test_robust_on_two_rows(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    r = ft.fit_robust(df.withColumn("g", F.lit(1)), ["g"], "v").first()
    lo, hi = np.quantile([0, 1], [0.005, 0.995])
    c = np.clip([0, 1], lo, hi)
    assert np.allclose([r["median"], r["raw_iqr"]], [np.median(c), np.diff(np.quantile(c, [0.25, 0.75]))[0]])


def test_band_power(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=64)
    r = ft.band_power(spark.createDataFrame([(x.tolist(),)], "s array<double>"), "s", [(0.0, 0.1), (0.1, 0.3)], 1.0).first()["power"]
    h = np.hanning(64)
    f = np.fft.rfftfreq(512)
    p = np.abs(np.fft.rfft((x - x.mean()) * h, 512)) ** 2 / np.sum(h**2) * (f[1] - f[0])
    assert np.allclose(r, [p[f < 0.1].sum(), p[(f >= 0.1) & (f < 0.3)].sum()])
    with pytest.raises(ValueError):
        ft.band_power(spark.range(1), "id", [(0.0, 0.5)], 1.0)


def test_near_equal_bins(spark):
    for n in (8, 9, 13, 23):
        got = [r[0] for r in spark.range(n).select(ft.near_equal_bin(F.col("id"), F.lit(n))).collect()]
        assert got == [b for b, part in enumerate(np.array_split(np.arange(n), 8)) for _ in part]


def test_rank_statistics(spark, frame):
    pdf = frame[["row", "v"]].assign(a=frame["v"].round(1), b=(frame["v"] * 3 + frame["row"] % 7).round(1), c=frame["row"] % 5)
    df = spark.createDataFrame(pdf[["a", "b", "c"]])
    assert np.isclose(st.spearman(df, "a", "b").first()["rho"], pdf["a"].rank().corr(pdf["b"].rank()))
    ra, rb, rc = (pdf[x].rank().to_numpy() for x in "abc")
    design = np.column_stack([np.ones(len(pdf)), rc])
    left, right = (r - design @ np.linalg.lstsq(design, r, rcond=None)[0] for r in (ra, rb))
    assert np.isclose(st.partial_spearman(df, "a", "b", ["c"]).first()["rho"], np.corrcoef(left, right)[0, 1])
    assert st.spearman(df.withColumn("k", F.lit(1.0)), "a", "k").first()["rho"] == 0.0


def test_auroc_and_diagnostics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    wins = sum((p > q) + 0.5 * (p == q) for p in (0.35, 0.8, 0.4) for q in (0.1, 0.4))
    assert np.isclose(st.auroc(df, "s", "y").first()["auroc"], wins / 6)
    w = np.array([0.0, 1.0, 1.0, 2.0, 5.0])
    r = st.weight_diagnostics(spark.createDataFrame([(float(x),) for x in w], "w double"), "w").first()
    p = w[w > 0] / w.sum()
    assert np.isclose(r["normalized_entropy"], -(p * np.log(p)).sum() / np.log(5))
    assert np.isclose(r["gini"], np.abs(w[:, None] - w[None, :]).sum() / (2 * 5 * w.sum()))


def test_permutation_keeps_block_counts(spark):
    rows = [(i, "hot" if i < 50 else "b", i % 3, (i // 2) % 3) for i in range(70)]
    out = st.permutation_null(spark.createDataFrame(rows, "r int, b string, y int, p int"), "r", "b", "y", "p", 40, 1).toPandas()
    assert len(out) == 40 and out["recall"].between(0, 1).all() and out["recall"].std() > 0
    perfect = st.permutation_null(spark.createDataFrame([(i, str(i), i % 2, i % 2) for i in range(6)], "r int, b string, y int, p int"), "r", "b", "y", "p", 3, 1).toPandas()
    assert (perfect["recall"] == 1.0).all()  # blocks of one cannot be shuffled


def test_bootstrap_resamples_entities(spark):
    v = spark.createDataFrame([(f"e{i}", float(i)) for i in range(20)], "e string, v double")
    a = st.cluster_bootstrap(v, "e", "v", 200, 3).first()
    b = st.cluster_bootstrap(v.repartition(4), "e", "v", 200, 3).first()
    assert a == b and a["n_entities"] == 20 and a["positive_entities"] == 19 and a["ci_low"] < 9.5 < a["ci_high"]
    with pytest.raises(ValueError):
        st.paired_differences(v, v.filter("v > 3"), "e", "v")


def test_weights_by_hand(spark):
    rows = [("b", "s1", 4.0), ("b", "s1", -1.0), ("b", "s2", -2.0), ("b", "s3", 1.0), ("z", "s4", -1.0)]
    got = {r["s"]: r for r in wt.positive_weights(spark.createDataFrame(rows, "b string, s string, u double"), ["b"], "s", "u", 1.0).collect()}
    raw = {"s1": 2.0, "s2": 0.1 * 1.0, "s3": 1.0}  # lower median of {1, 2} is 1
    total = sum(raw.values())
    for s, x in raw.items():
        assert np.isclose(got[s]["weight"], 3 * x / (total + 1e-8))
    assert got["s2"]["floor_hit"] and got["s4"]["all_zero_batch"] and np.isclose(got["s4"]["weight"], 1.0)


def test_two_parameter_recovery(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, (a, b) in enumerate([(0.8, -0.5), (1.6, 0.4), (1.2, 0.0)]):
        q = rng.normal(size=3000)
        y = rng.random(3000) < 1 / (1 + np.exp(-a * (q - b)))
        rows += [(k, float(x), float(t)) for x, t in zip(q, y)]
    got = fits.fit_two_parameter(spark.createDataFrame(rows, "i int, q double, y double"), "i", "q", "y").toPandas().set_index("i")
    assert np.allclose(got["a"].sort_index(), [0.8, 1.6, 1.2], atol=0.2) and np.allclose(got["b"].sort_index(), [-0.5, 0.4, 0.0], atol=0.2)


def test_plateau_and_sustained_level(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.1, 0.2, 0.203, 0.204, 0.4])] + [("h", i, float(i)) for i in range(4)], "g string, s int, v double")
    assert dict(st.plateau_step(df, ["g"], "s", "v").collect()) == {"g": 3, "h": None}
    lv = spark.createDataFrame([("a", i, p) for i, p in enumerate([True, True, False, True, True])] + [("b", 0, True), ("b", 1, True)], "g string, l int, p boolean")
    assert dict(st.first_sustained_level(lv, ["g"], "l", "p").collect()) == {"a": 3, "b": None}


def test_vocabulary_blocks_agree(spark):
    rng = np.random.default_rng(6)
    vocab = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(30)], "k int, w array<double>")
    rows = spark.createDataFrame([(i, i % 30, rng.normal(size=3).tolist()) for i in range(40)], "r int, t int, q array<double>")
    a = pb.score_vocabulary(rows, "r", "q", "t", vocab, "k", "w", block=1000).toPandas().sort_values("r")
    b = pb.score_vocabulary(rows, "r", "q", "t", vocab, "k", "w", block=2).toPandas().sort_values("r")
    assert np.allclose(a["log_probability"], b["log_probability"]) and a["best_item"].tolist() == b["best_item"].tolist()


def test_hypergeometric_inverts_exact_sums():
    from math import comb

    for total, marked, taken in ((10, 4, 5), (30, 30, 7), (25, 0, 3), (40, 13, 29), (7, 3, 7)):
        low, high = max(0, taken + marked - total), min(marked, taken)
        sums = np.cumsum([comb(marked, x) * comb(total - marked, taken - x) / comb(total, taken) for x in range(low, high + 1)])
        u = np.linspace(0.001, 0.999, 301)
        assert (st._hypergeometric(total, marked, taken, u) == low + np.searchsorted(sums, u)).all()
    big = st._hypergeometric(10**12, 4 * 10**11, 10**11, np.random.default_rng(1).random(2000))
    assert abs(big.mean() / 4e10 - 1) < 1e-5 and abs(big.std() / np.sqrt(4e10 * 0.6 * 0.9) - 1) < 0.1


def test_dealt_tables_keep_margins_and_match_shuffles():
    rng = np.random.default_rng(2)
    labels, given = [5, 20, 11], [9, 0, 17, 10]
    t = st._tables(labels, given, lambda k, j: np.random.default_rng([k, j, 3]).random(4000))
    assert (t >= 0).all() and (t.sum(axis=2) == labels).all() and (t.sum(axis=1) == given).all()
    y, p = np.repeat(range(3), labels), np.repeat(range(4), given)
    s = np.array([[np.sum((rng.permutation(y) == k) & (p == k)) for k in range(3)] for _ in range(4000)])
    assert np.allclose(t[:, range(3), range(3)].mean(axis=0), [n * m / 36 for n, m in zip(labels, given)], atol=0.1)
    recall = lambda h: (h / labels).mean(axis=1)
    own = recall(t[:, range(3), range(3)])
    # the same label is drawn on its own here, so only means and spreads of single classes are compared with shuffles
    assert np.allclose(t[:, range(3), range(3)].std(axis=0), s.std(axis=0), rtol=0.1, atol=0.05) and abs(own.mean() - recall(s).mean()) < 0.01


def test_permutation_null_matches_shuffles(spark):
    """Mean and upper quantile lie within Monte-Carlo error of shuffled rows; order, chunks and partitions do not matter."""
    rng = np.random.default_rng(4)
    y, p, b = rng.integers(0, 3, 300), rng.integers(0, 3, 300), np.repeat(["hot", "b", "c"], [200, 60, 40])
    df = spark.createDataFrame([(i, str(b[i]), int(y[i]), int(p[i])) for i in range(300)], "r int, b string, y int, p int")
    a = st.permutation_null(df, "r", "b", "y", "p", 600, 1).orderBy("draw").toPandas()["recall"]
    again = st.permutation_null(df.repartition(5), "r", "b", "y", "p", 600, 1).orderBy("draw").toPandas()["recall"]
    smaller = st.permutation_null(df, "r", "b", "y", "p", 600, 1, chunk=50).orderBy("draw").toPandas()["recall"]
    assert np.allclose(a, again) and np.allclose(a, smaller)
    ref = []
    for _ in range(600):
        s = y.copy()
        for x in ("hot", "b", "c"):
            s[b == x] = rng.permutation(s[b == x])
        ref.append(np.mean([np.mean(p[s == k] == k) for k in range(3)]))
    assert abs(a.mean() - np.mean(ref)) < 0.006 and abs(np.quantile(a, 0.95) - np.quantile(ref, 0.95)) < 0.012


def test_shuffled_labels_null_deals_every_row(spark):
    """Each draw equals labels dealt row by row in hash order."""
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(i, "ab"[int(rng.integers(2))], int(rng.integers(3)), int(rng.integers(3))) for i in range(80)]
    got = st.shuffled_labels_null(spark.createDataFrame(rows, "r int, b string, y int, p int"), "r", "b", "y", "p", 20, 7).orderBy("draw").toPandas()["recall"]
    size = {y: sum(r[2] == y for r in rows) for y in range(3)}
    for d in range(20):
        hits = dict.fromkeys(size, 0)
        for b in "ab":
            mine = [r for r in rows if r[1] == b]
            dealt = sorted(mine, key=lambda r: (hashlib.sha256(f"7|{d}|{r[0]}".encode()).hexdigest(), r[0]))
            for x, slot in zip(dealt, mine):
                hits[x[2]] += x[2] == slot[3]
        assert abs(got[d] - sum(hits[y] / size[y] for y in size) / 3) < 1e-12


def test_bootstrap_draws_keep_one_sum_per_draw(spark):
    """Draws are not merged per entity before the join: that table has entities x draws groups. Values equal the hash draws."""
    import hashlib

    values = [float(i * i % 17) for i in range(30)]
    d = st.bootstrap_draws(spark.createDataFrame([(f"e{i:02d}", v) for i, v in enumerate(values)], "e string, v double"), "e", "v", 12, 5)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {r["draw"]: r["estimate"] for r in d.collect()}
    pick = lambda k, s: values[int(hashlib.sha256(f"5|{k}|{s}".encode()).hexdigest()[:15], 16) % 30]
    assert got.keys() == set(range(12)) and all(abs(got[k] - sum(pick(k, s) for s in range(30)) / 30) < 1e-12 for k in got)


def test_sparse_windows_equal_the_dense_ones(spark):
    rows = [(1, 0, 1.5), (1, 5, 2.0), (1, 9, 3.0), (2, 3, -1.0), (2, 12, 8.0), (2, None, 4.0), (3, 40, 7.0), (None, 2, 6.0)]
    df = spark.createDataFrame(rows, "u int, h int, v double")
    sums = df.filter("u is not null").withColumnRenamed("v", "w")
    grid = df.select("u").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(9)))).join(sums, ["u", "h"], "left").select("u", "h", F.coalesce("w", F.lit(0.0)).alias("v"))
    want = ft.window_signals(ft.complete_windows(grid, "u", "h", F.lit(10), 4, 2), "u", "v")
    key = lambda d: sorted((str(r.u), r.window_start, r.signal) for r in d.collect())
    got = ft.sparse_window_signals(df, "u", "h", "v", 10, 4, 2)
    assert got.dtypes == want.dtypes and key(got) == key(want) and len(key(got)) == 16


def test_sparse_windows_shuffle_no_zeros(spark):
    """A record of one sample sends one row, however long it is."""
    df = spark.createDataFrame([(1, 3, 2.0)], "u int, h int, v double")
    plan = ft.sparse_window_signals(df, "u", "h", "v", 720, 48, 24)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(") < plan.index("Exchange hashpartitioning(u") and plan.count("Exchange") == 1 and "Join" not in plan
