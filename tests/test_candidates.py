"""Funnel and draws against plain Python, over several blocks and with the tight-cut fallback."""

import hashlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from heldout.operators import candidates as cd
from heldout.operators import similarity as sm
from heldout.operators.durable import durable


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        v = rng.normal(size=4)
        v = v / np.linalg.norm(v)
        rows.append(("hot" if i < 70 else "cold", i, int(rng.integers(5, 12)), v.tolist()))
    return rows, spark.createDataFrame(rows, "s string, id long, n long, v array<double>")


def expected(rows, history, threshold):
    out = {}
    for s, i, n, v in rows:
        others = [r for r in rows if r[0] == s and r[1] != i]
        a = [r for r in others if 3 * n <= 4 * r[2] <= 5 * n]
        b = [r for r in a if np.dot(v, r[3]) <= threshold]
        c = [r[1] for r in b if (i, r[1]) not in history]
        out[i] = (len(others), len(a), len(b), c)
    return out


def test_funnel_and_draws(spark, pool, monkeypatch):
    rows, df = pool
    history = {(i, i - 1) for i in range(1, 90)}
    h = spark.createDataFrame(sorted(history), "target long, source long")
    want = expected(rows, history, 0.3)
    counts = cd.funnel(df, h, ["s"], "id", "n", "v", 0.3)
    for r in counts.collect():
        o, a, b, c = want[r["target"]]
        assert (r["after_target_exclusion"], r["length_pass"], r["cosine_pass"], r["legal_count"]) == (o, a, b, len(c))
    for margin in (None, 0.0):  # with a hopeless cut the exact second pass must fill every list
        if margin is not None:
            monkeypatch.setattr(cd.math, "sqrt", lambda x: -5.0)
        d = cd.ranked_draws(df, counts, h, ["s"], "id", "n", "v", 0.3, k=5, repeats=2, seed=9, task="t", block=16).collect()
        got = {}
        for r in d:
            got.setdefault((r["target"], r["repeat"]), []).append((r["rank"], r["negative"]))
        for s, i, _, _ in rows:
            for rep in range(2):
                order = sorted(want[i][3], key=lambda x: hashlib.sha256(f"9|t|{s}|{i}|{rep}|{x}".encode()).hexdigest())[:5]
                assert [x for _, x in sorted(got.get((i, rep), []))] == order


def test_blocks_see_every_pair_once(spark, pool):
    rows, df = pool
    one = {r["id"]: r for r in cd.pool_statistics(df, ["s"], "id", "n", "v", 0.3, block=1000).collect()}
    many = {r["id"]: r for r in cd.pool_statistics(df, ["s"], "id", "n", "v", 0.3, block=9).collect()}
    assert one.keys() == many.keys()
    for k in one:
        assert one[k].evaluated == many[k].evaluated and one[k].above == many[k].above and one[k].closest == many[k].closest


def test_eight_or_nine_negatives(spark):
    df = spark.createDataFrame([(8, 8, 8), (9, 9, 9), (9, 8, 8), (9, 9, 8)], "length_pass long, cosine_pass long, legal_count long")
    got = [(r["eligible"], r["failure_stage"]) for r in cd.common_support(df).collect()]
    assert got == [(False, "length"), (True, None), (False, "cosine"), (False, "H")]


def test_projection_errors(spark):
    base = spark.createDataFrame([(1, 0, 3, [5, 6, 7]), (2, 0, 2, [8, 9])], "t int, r int, n int, x array<int>")
    derived = spark.createDataFrame([(1, 0, 3, [6, 5]), (3, 0, 1, [1])], "t int, r int, n int, x array<int>")
    got = {r["t"]: r["errors"] for r in cd.projection_errors(base, derived, ["t", "r"], ["n"], "ORDER", "x").collect()}
    assert got == {1: ["ORDER_CHANGED"], 2: ["DROPPED_TARGET"], 3: ["UNKNOWN_TARGET"]}


def test_closest_pair(spark):
    texts = {1: "the cat sat", 2: "dogs run far", 3: "the cat sits", 4: "zz"}
    w = sm.trigram_weights(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text")
    r = sm.closest_pair(w, "id", "tri", "weight").first()
    assert (r["i"], r["j"]) == (1, 3)


def _vectors(spark, m):
    return spark.createDataFrame([(i, j, float(x)) for i, v in enumerate(m) for j, x in enumerate(v) if x], "id long, f long, w double")


@pytest.mark.parametrize("seed", range(3))
def test_cosine_join_equals_brute_force(spark, monkeypatch, seed):
    """Small rings, centres and sketches, so that every bound has work to do; ties, copies and lone vectors included."""
    monkeypatch.setattr(sm, "HEAD", 4)
    monkeypatch.setattr(sm, "RING", 7)
    monkeypatch.setattr(sm, "PER_CENTRE", 20)
    rng = np.random.default_rng(seed)
    m = np.abs(rng.normal(size=(12, 9)))[rng.integers(0, 12, 150)] * rng.choice([1, 1, 0.2], (150, 9)) + rng.choice([0, 0.3], (150, 9))
    m[140:] = m[:10]
    m[0] = [1] + [0] * 8
    m /= np.linalg.norm(m, axis=1)[:, None]
    copies = rng.integers(1, 5, 150)
    items = spark.createDataFrame([(i, int(c)) for i, c in enumerate(copies)], "id long, copies long")
    got = {r.id: r for r in sm.neighbour_profile(_vectors(spark, m), items, "id", "f", "w", "copies", 0.9).collect()}
    cos = m @ m.T
    np.fill_diagonal(cos, -1)
    near = cos > 0.9
    assert set(got) == set(np.flatnonzero(near.any(axis=1)))
    for i, r in got.items():
        assert (r.similar_items, r.similar_weight) == (near[i].sum(), copies[near[i]].sum()) and abs(r.nearest - cos[i].max()) < 1e-9
    best = sm.closest_pair(_vectors(spark, m), "id", "f", "w").first()
    top = np.round(np.where(np.triu(np.ones_like(cos), 1) > 0, cos, -1), 12)
    assert (best.i, best.j) == min(zip(*np.nonzero(top == top.max())))


def test_cosine_join_looks_at_few_pairs(spark):
    """On the largest given documents less than a tenth of all ordered pairs is multiplied out."""
    from heldout.operators.features import hashed_bag

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    w = durable(hashed_bag(docs, "doc_id", "text"))
    n = w.select("doc_id").distinct().count()
    kernel_pairs = sm.neighbour_profile(w, docs.select("doc_id", F.lit(1).cast("long").alias("copies")), "doc_id", "bucket", "weight", "copies", 0.9, all_rows=True).agg(F.sum("looked")).first()[0]
    print(f"{kernel_pairs} of {n * (n - 1)} pairs looked at")
    assert kernel_pairs < n * (n - 1) / 10


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_clustered_pool_skips_block_pairs(spark, threshold):
    """Tight clusters: statistics equal brute force, and most block pairs need no product."""
    rng = np.random.default_rng(7)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0][:6]
    v = centres[rng.integers(0, 6, 240)] + rng.normal(size=(240, 12)) * 0.02
    v *= rng.uniform(0.97, 1.0, (240, 1)) / np.linalg.norm(v, axis=1)[:, None]
    v[5] = v[6]
    v[7] = 0
    n = rng.choice([0, 3, 10, 11, 13, 40], 240)
    df = spark.createDataFrame([("s", i, int(n[i]), v[i].tolist()) for i in range(240)], "s string, id long, n long, v array<double>")
    cos = v @ v.T
    legal = (3 * n[:, None] <= 4 * n[None]) & (4 * n[None] <= 5 * n[:, None]) & ~np.eye(240, dtype=bool)
    got = {r.id: r for r in cd.pool_statistics(df, ["s"], "id", "n", "v", threshold, block=10).collect()}
    assert set(got) == set(np.flatnonzero(legal.any(axis=1)))
    for i, r in got.items():
        c = cos[i][legal[i]]
        gap = np.abs(c - threshold)
        assert (r.evaluated, r.above, r.equal) == (legal[i].sum(), (c > threshold).sum(), (c == threshold).sum())
        assert abs(r.maximum - c.max()) < 1e-12 and abs(r.distance - gap.min()) < 1e-12
    _, table = cd.pivot_blocks(df, ["s"], "id", "n", "v", block=10)
    share = {r.decision: r["count"] for r in cd.block_pairs(table, ["s"], threshold).groupBy("decision").count().collect()}
    assert share["open"] < 0.25 * sum(share.values()) and share["below"] and share["above"], share


def test_nearest_of_all_far_items(spark):
    """Every item that shares a feature learns its nearest one, also far below the threshold; one that shares none has no row."""
    rng = np.random.default_rng(8)
    m = rng.random((60, 200)) * (rng.random((60, 200)) < 0.08)
    m[7], m[7, 199], m[:7, 199], m[8:, 199] = 0, 1.0, 0, 0
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    items = spark.range(60).select("id", F.lit(2).cast("long").alias("copies"))
    got = {r.id: r.nearest for r in sm.neighbour_profile(_vectors(spark, m), items, "id", "f", "w", "copies", 0.9, nearest_of_all=True).collect()}
    cos = m @ m.T - 2 * np.eye(60)
    want = {i: cos[i].max() for i in range(60) if cos[i].max() > 0}
    assert 7 not in want and max(want.values()) < 0.9
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_visits_leave_in_pieces(spark):
    """The hits of a batch leave its task in pieces of a given size, without sketches; pieces change no visit."""
    m = np.random.default_rng(9).random((300, 160))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows, rings, centres = sm.ringed(sm.sketches(_vectors(spark, m), "id", "f", "w"), "id")
    rows = rows.withColumn("least", F.lit(0.0))
    a, b = (sm.visits(rows, rings, centres, "id", piece=p) for p in (7, 65_536))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_all_pairs_in_rounds_of_blocks(spark, monkeypatch, seed):
    """Several blocks, rounds, slices of dimensions and tiles give brute force; no round sends a vector to more than a few blocks."""
    for name, value in {"BLOCK": 40, "LEAST": 8, "SLICE": 7, "VISITED": 2}.items():
        monkeypatch.setattr(sm, name, value)
    inner, sent = sm._every_cosine, []
    monkeypatch.setattr(sm, "_every_cosine", lambda *a: inner(*a, row_tile=16, column_tile=24))
    monkeypatch.setattr(sm, "durable", lambda df: sent.append(durable(df)) or sent[-1])
    rng = np.random.default_rng(seed)
    m = rng.random((300, 20)) * (rng.random((300, 20)) < 0.3)
    m[200:240], m[260:290] = m[100:140], m[7]  # copies, and a group of equal vectors
    m[240:260] = np.abs(m[100:120] + rng.normal(size=(20, 20)) * 0.02)
    m[3], m[:, 19] = 0, 0
    m[4], m[4, 19] = 0, 1.0
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    copies = rng.integers(1, 5, 300)
    items = spark.createDataFrame([(i, int(c)) for i, c in enumerate(copies)], "id long, copies long")
    got = {r.id: r for r in sm.neighbour_profile(_vectors(spark, m), items, "id", "f", "w", "copies", 0.9, nearest_of_all=True).collect()}
    cos = m @ m.T
    np.fill_diagonal(cos, -1)
    near = cos > 0.9
    assert set(got) == set(np.flatnonzero(cos.max(axis=1) > 0)) and 4 not in got
    for i, r in got.items():
        assert (r.similar_items, r.similar_weight) == (near[i].sum(), copies[near[i]].sum()) and abs(r.nearest - cos[i].max()) < 1e-12
    n = int((m.max(axis=1) > 0).sum())
    assert got[0].looked == n - 1
    rounds = [t for t in sent if "looked" in t.columns]
    assert len(rounds) == 6 and max(t.count() for t in rounds) <= 3 * n  # twelve blocks, two a round


def test_a_large_pool_has_few_block_pairs(spark, monkeypatch):
    """Small blocks grow with the pool, so calls do not; statistics stay those of brute force."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(4000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    n = np.exp(rng.normal(4, 1, 4000)).astype(int) + 1
    df = spark.createDataFrame([("s", i, int(n[i]), v[i].tolist()) for i in range(4000)], "s string, id long, n long, v array<double>")
    called, inner = [], cd._multiplied
    monkeypatch.setattr(cd, "_multiplied", lambda rows, pairs, *rest: called.append(pairs.count()) or inner(rows, pairs, *rest))
    got = {r.id: r for r in cd.pool_statistics(df, ["s"], "id", "n", "v", 0.3, block=4).collect()}
    assert sum(called) < 4000
    cos = v @ v.T
    legal = (3 * n[:, None] <= 4 * n[None]) & (4 * n[None] <= 5 * n[:, None]) & ~np.eye(4000, dtype=bool)
    assert set(got) == set(np.flatnonzero(legal.any(axis=1)))
    for i in range(0, 4000, 7):
        if i in got:
            r, c = got[i], cos[i][legal[i]]
            gap = np.abs(c - 0.3)
            assert (r.evaluated, r.above, r.equal) == (legal[i].sum(), (c > 0.3).sum(), (c == 0.3).sum()) and r.closest == np.flatnonzero(legal[i])[gap.argmin()]
            assert abs(r.maximum - c.max()) < 1e-12 and abs(r.distance - gap.min()) < 1e-12


def test_a_meeting_of_blocks_gives_the_lowest_hashes():
    """Legal pairs of two blocks are hashed in their task, which gives no more than so many of each target and repeat."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 3))
    n = rng.integers(5, 12, 40)
    a = pa.table({"s": ["x"] * 40, "target": np.arange(40), "_tl": n, "_tv": v.tolist(), "_head": [f"9|t|x|{i}" for i in range(40)], "_cut": np.full(40, 1 << 31)})
    c = pa.table({"negative": np.arange(40), "_nl": n, "_nv": v.tolist(), "_tail": [str(i) for i in range(40)]})
    got = {}
    for r in cd._drawn(a, c, ["s"], 0.3, 2, 4).to_pylist():
        got.setdefault((r["target"], r["repeat"]), []).append((r["_h"], r["negative"]))
    held = 0
    for i in range(40):
        for repeat in range(2):
            digests = sorted((hashlib.sha256(f"9|t|x|{i}|{repeat}|{j}".encode()).digest(), j) for j in range(40) if j != i and 3 * n[i] <= 4 * n[j] <= 5 * n[i] and v[i] @ v[j] <= 0.3)
            low = [d for d in digests if int.from_bytes(d[0][:4]) <= 1 << 31]
            held += len(low) > 4
            assert sorted(got.get((i, repeat), [])) == low[:4]
    assert held > 10 and cd._drawn(a.slice(0, 0), c, ["s"], 0.3, 2, 4).num_rows == 0
