"""Null controls keep their guarantees; the class flow equals a brute-force matching."""

import itertools
import random

from pyspark.sql import functions as F

from heldout.operators import nulls


def test_cycle_has_no_fixed_point(spark):
    rows = [(f"r{i % 30}" if i < 300 else "hot", i, float(i)) for i in range(900)] + [("single", 5000, 1.0)]
    df = spark.createDataFrame(rows, "r string, u long, x double")
    out = nulls.cycle_donors(df, ["r"], "u", 1, "arm", {"u": "d"}).toPandas()
    paired = out.dropna(subset=["d"])
    assert (paired["u"] != paired["d"]).all() and sorted(paired["u"]) == sorted(paired["d"]) and len(out) == len(rows)
    assert out[out["r"] == "single"]["reason"].tolist() == ["FEWER_THAN_TWO_UNITS"]


def test_block_cycle(spark):
    for r in spark.range(30).select(nulls.block_cycle(7, F.lit(1), F.col("id")).alias("p")).collect():
        p = r["p"]
        assert sorted(p) == list(range(7)) and all(i != v for i, v in enumerate(p))
        at, seen = 0, 0
        while True:
            at, seen = p[at], seen + 1
            if at == 0:
                break
        assert seen == 7


def legal(a, b):
    return a[0] != b[0] and 3 * a[1] <= 4 * b[1] <= 5 * a[1]


def brute(rows):
    active = set(range(len(rows)))
    while True:
        gone = {i for i in active if not any(legal(rows[i], rows[j]) for j in active)}
        if not gone:
            break
        active -= gone
    act = sorted(active)
    perfect = any(all(legal(rows[i], rows[j]) for i, j in zip(act, p)) for p in itertools.permutations(act))
    return active, perfect


def test_flow_equals_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        rows = [(rng.choice("abc"), rng.choice([2, 3, 4, 5, 6, 9])) for _ in range(rng.randint(1, 6))]
        classes = sorted({(g, u, rows.count((g, u))) for g, u in rows}, key=lambda c: (c[1], c[0]))
        active, flow = nulls._flow(classes)
        want_active, perfect = brute(rows)
        assert sum(c[2] for c, a in zip(classes, active) if a) == len(want_active)
        assert (flow is not None) == perfect
        if flow:
            for (i, j), n in flow.items():
                assert n > 0 and legal(classes[i], classes[j])
            for k, c in enumerate(classes):
                if active[k]:
                    assert sum(n for (i, _), n in flow.items() if i == k) == c[2] == sum(n for (_, j), n in flow.items() if j == k)


def test_matching_guarantees(spark):
    rng = random.Random(2)
    rows = [("hot" if i < 400 else f"b{i % 9}", f"r{i}", f"g{rng.randint(0, 5)}", rng.randint(3, 12)) for i in range(600)]
    df = spark.createDataFrame(rows, "b string, r string, g string, n long")
    out = nulls.match_donors(df, ["b"], "r", "g", "n", 1).toPandas()
    assert sorted(out["r"]) == sorted(r[1] for r in rows)
    ok = out.dropna(subset=["donor_id"])
    assert sorted(ok["r"]) == sorted(ok["donor_id"]) and (ok["g"] != ok["donor_group"]).all() and len(ok) > 0
    assert ((3 * ok["n"] <= 4 * ok["donor_units"]) & (4 * ok["donor_units"] <= 5 * ok["n"])).all()
    assert out[out["donor_id"].isna()]["reason"].notna().all()


def test_half_even_positions(spark):
    df = spark.range(5).select(nulls.resample_position(F.col("id"), F.lit(5), F.lit(3)).alias("p"))
    assert [r["p"] for r in df.collect()] == [round(i * 2 / 4) for i in range(5)]
