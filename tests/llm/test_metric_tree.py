import math
import random

import pytest
from pyspark.sql import functions as F

from heldout.llm import metric_tree as M


def brute(rows, step, k):
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        clean[i] = min(clean.get(i, w), w)
    out = []
    for q in clean:
        if q % step == 0:
            best = sorted(((-sum(a * b for a, b in zip(clean[q], w)), i) for i, w in clean.items() if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "ties", "odd", "few", "empty", "clusters"])
def test_equals_brute_force(spark, case):
    rnd = random.Random(case)
    normal = lambda d: [float(f"{rnd.gauss(0, 1):.6f}") for _ in range(d)]
    centers = [normal(16) for _ in range(12)]
    rows = {
        "random": [(i, normal(12)) for i in range(1500)], "few": [(i * 5, normal(3)) for i in range(4)], "empty": [],
        "ties": [(i, [1.0, 0.5] if i % 3 else [float(rnd.randint(-1, 1)), 0.25]) for i in range(900)],
        "odd": [(0, None), (5, [None, 1.0]), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, []), (25, [0.0, 0.0]), (30, [1.0, 2.0]), (30, [1.0, 2.0]), (35, [-3.0, 1.0]), (40, [0.001, -0.001]), (41, [2.0])],
        "clusters": [(i, [c + rnd.gauss(0, 0.05) for c in centers[i % 12]]) for i in range(2000)],
    }[case]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, route int, part int, score long")
    got = M.top_k(table, F.col("vec_id") % 5 == 0, k=5, routes=8, tree=300)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 5)


def test_bounds_spare_computations():
    """Pages outside the ball are not opened."""
    import numpy as np

    rnd = np.random.default_rng(1)
    v = np.concatenate([rnd.integers(-5, 5, (500, 8)) + c for c in rnd.integers(-900, 900, (8, 8))])
    top = int((v * v).sum(1).max())
    e, pages = M._build(v, np.arange(len(v)), top)
    for parent, leaf, center, radius, up, rows, d in pages:
        if leaf:
            assert d.max() <= radius + 1e-9
    assert sum(len(p[5]) for p in pages) == len(v) and len(pages) > 8
