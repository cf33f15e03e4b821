"""Range-cut ranking against plain Python, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from heldout.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    return pd.DataFrame({"g": ["hot"] * 3000 + [f"g{i % 40}" for i in range(900)], "id": rng.permutation(3900), "v": rng.integers(0, 50, 3900).astype(float)})


def test_positions_and_sums(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    got = rk.running_sum(rk.positions(df, ["g"], ["id"], "p"), ["g"], ["id"], F.col("v"), "s").toPandas().sort_values(["g", "id"])
    want = skewed.sort_values(["g", "id"]).assign(p=lambda d: d.groupby("g").cumcount(), s=lambda d: d.groupby("g")["v"].cumsum())
    assert got["p"].tolist() == want["p"].tolist()
    assert np.allclose(got["s"], want["s"])


def test_global_positions(spark, skewed):
    got = rk.positions(spark.createDataFrame(skewed), [], [F.col("v").desc(), "id"], "p").toPandas().sort_values("p")
    want = skewed.sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist() and got["p"].tolist() == list(range(len(want)))


def test_neighbours_and_preceding(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = rk.neighbours(df, ["g"], ["id"], {"v": "prev"}, -1).toPandas().sort_values(["g", "id"])
    want = skewed.sort_values(["g", "id"]).groupby("g")["v"].shift(1)
    assert np.allclose(got["prev"].to_numpy(float), want.to_numpy(float), equal_nan=True)
    pre = rk.preceding(df, ["g"], ["id"], "v", 2, "a").toPandas().sort_values(["g", "id"])
    values = skewed.sort_values(["g", "id"])
    for g, part in values.groupby("g"):
        vs = part["v"].tolist()
        assert [list(a) for a in pre[pre["g"] == g]["a"]] == [vs[max(0, i - 2):i] for i in range(len(vs))]


@pytest.mark.parametrize("rule", ["linear", "lower", "floor_index"])
def test_quantiles(spark, skewed, rule):
    probs = {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.005}
    got = rk.exact_quantiles(spark.createDataFrame(skewed), ["g"], "v", probs, rule).toPandas().set_index("g")
    for g, part in skewed.groupby("g"):
        x = np.sort(part["v"].to_numpy())
        n = len(x)
        for name, p in probs.items():
            if rule == "linear":
                want = np.quantile(x, p)
            elif rule == "lower":
                want = x[max(int(np.ceil(p * n)) - 1, 0)]
            else:
                want = x[int(np.floor((n - 1) * round(p * 4) / 4))] if p != 0.005 else x[int((n - 1) * p)]
            assert got.loc[g, name] == pytest.approx(want), (g, name)


def test_floor_index_quartiles_differ_from_percentile(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 7)], "x int")
    assert rk.exact_quantiles(df, [], "x", {"q3": 0.75}, "floor_index").first()["q3"] == 4


def test_average_ranks(spark, skewed):
    got = rk.average_ranks(spark.createDataFrame(skewed), ["g"], "v").toPandas().sort_values(["g", "id"])
    want = skewed.sort_values(["g", "id"]).groupby("g")["v"].rank()
    assert np.allclose(got["rank"], want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(hs.sampled_from(["a", "b"]), hs.integers(-3, 3)), min_size=1, max_size=30))
def test_positions_property(spark, rows):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v int, i int")
    got = {(r["g"], r["i"]): r["p"] for r in rk.positions(df, ["g"], ["v", "i"], "p").collect()}
    for g in {"a", "b"}:
        order = sorted((v, i) for i, (h, v) in enumerate(rows) if h == g)
        assert [got[(g, i)] for _, i in order] == list(range(len(order)))
