"""Exact top-k inner products by best-first search in M-trees.

An extra coordinate gives all vectors the same norm, so the largest inner
product is the smallest Euclidean distance and the triangle inequality holds.
Vectors go to the nearest of a fixed number of routing objects; each routing
object's vectors are cut into trees of bounded size, kept as rows of pages with
covering radii and distances to the parent. Queries are first sent to the tree
nearest to them, which bounds their k-th distance, then to every routing
object whose ball reaches within that bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heldout.operators.durable import durable

from .registry import query

#: Routing objects (a bounded sample), vectors in a tree, entries in a page, queries that travel together.
ROUTES, TREE, PAGE, TOGETHER = 32, 8192, 128, 256
TREES = "route int, part int, dims int, parent array<int>, leaf array<boolean>, center binary, lift array<double>, radius array<double>, to_parent array<double>, ids array<array<long>>, rows binary, to_center binary"


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 * x) of every component; a vector that is NULL or holds a NULL or non-finite component takes no part.

    Rows without an id take no part, and of an id's several rows the smallest
    vector counts. Shorter vectors are filled with zeros. Components are whole
    64-bit numbers and so are scores.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _lift(v: np.ndarray, top: int) -> np.ndarray:
    return np.sqrt(np.maximum(top - (v * v).sum(1), 0).astype(float))


def _between(v, e, c, g) -> np.ndarray:
    """Distances of lifted rows (v, e) to one lifted center (c, g)."""
    d = v - c
    return np.sqrt((d * d).sum(1).astype(float) + (e - g) ** 2)


def _build(v: np.ndarray, ids: np.ndarray, top: int):
    """Pages of one tree, parents before children: each has a center, a radius and its distance to the parent's center."""
    e = _lift(v, top)
    pages: list[tuple] = []
    stack = [(np.arange(len(v)), 0, -1)]
    while stack:
        rows, center, parent = stack.pop()
        d = _between(v[rows], e[rows], v[center], e[center])
        up = 0.0 if parent < 0 else float(_between(v[center : center + 1], e[center : center + 1], v[pages[parent][2]], e[pages[parent][2]])[0])
        leaf = len(rows) <= PAGE
        pages.append((parent, leaf, center, float(d.max()), up, rows if leaf else rows[:0], d if leaf else d[:0]))
        if not leaf:
            me = len(pages) - 1
            n = min(16, -(-len(rows) // PAGE))
            centers = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
            near = np.argmin(np.stack([_between(v[rows], e[rows], v[c], e[c]) for c in centers]), 0)
            if np.bincount(near, minlength=n).max() == len(rows):  # all alike: cut by number
                near = np.arange(len(rows)) * n // len(rows)
                centers = [rows[near == j][0] for j in range(n)]
            stack += [(rows[near == j], c, me) for j, c in enumerate(centers) if (near == j).any()]
    return e, pages


def index(vectors: DataFrame, routes: int = ROUTES, tree: int = TREE):
    """(written tree rows, routing objects, the common squared norm, dimensions) over every row of ``scaled`` vectors."""
    rows = durable(vectors)
    top, dims, total = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x * x)), F.max(F.size("v")), F.count(F.lit(1))).first()
    if not total:
        return None
    sample = rows.orderBy(F.xxhash64(F.lit("route"), "vec_id"), "vec_id").limit(routes).collect()  # bounded by routes
    centers = _matrix([r["v"] for r in sample], dims)
    lifts = _lift(centers, top)

    @F.pandas_udf("int")
    def nearest(column: pd.Series) -> pd.Series:
        v = _matrix(column, dims)
        e = _lift(v, top)
        return pd.Series(np.argmin(np.stack([_between(v, e, c, g) for c, g in zip(centers, lifts, strict=True)]), 0))

    routed = durable(rows.withColumn("route", nearest("v")))
    parts = {r["route"]: -(-r["n"] // tree) for r in routed.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per routing object
    count = F.element_at(F.create_map(*[x for r, n in parts.items() for x in (F.lit(r), F.lit(n))]), F.col("route"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        v, ids = _matrix(pdf["v"], dims), pdf["vec_id"].to_numpy()
        e, pages = _build(v, ids, top)
        held = np.concatenate([p[5] for p in pages])
        return pd.DataFrame([(
            int(pdf["route"].iloc[0]), int(pdf["part"].iloc[0]), dims, [p[0] for p in pages], [p[1] for p in pages], v[[p[2] for p in pages]].tobytes(), [float(e[p[2]]) for p in pages],
            [p[3] for p in pages], [p[4] for p in pages], [ids[p[5]].tolist() for p in pages], v[held].tobytes(), np.concatenate([p[6] for p in pages]).tobytes(),
        )], columns=[c.split()[0] for c in TREES.split(", ")])

    trees = durable(routed.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), count).cast("int")).groupBy("route", "part").applyInPandas(build, TREES))
    # a tree's root is its first vector, not the routing object: the routing object's own ball has to hold every vector
    @F.pandas_udf("double")
    def off(column: pd.Series, route: pd.Series) -> pd.Series:
        v = _matrix(column, dims)
        e = _lift(v, top)
        d = v - centers[route.to_numpy()]
        return pd.Series(np.sqrt((d * d).sum(1).astype(float) + (e - lifts[route.to_numpy()]) ** 2))

    reach = {r["route"]: r["r"] for r in routed.withColumn("_d", off("v", "route")).groupBy("route").agg(F.max("_d").alias("r")).collect()}
    return rows, trees, centers, lifts, np.array([reach.get(j, -np.inf) for j in range(len(sample))]), top, dims


def _best_first(q, own, k, bound, tree, top) -> list[tuple[int, int]]:
    """The k best (score, -vec_id) of a tree for one query, among those that reach ``bound`` (a score or None)."""
    norm = int((q * q).sum())
    slack = 1e-6 * (np.sqrt(float(top)) + np.sqrt(float(norm)) + 1.0)
    reach = lambda s: np.sqrt(max(float(norm + top - 2 * s), 0.0)) + slack
    best: list[tuple[int, int]] = []
    limit = np.inf if bound is None else reach(bound)
    to_root = np.sqrt(max(float(norm + top - 2 * int(tree["center"][0] @ q)), 0.0))
    queue = [(max(0.0, to_root - tree["radius"][0]), 0, to_root)]
    while queue:
        low, page, d = heapq.heappop(queue)
        if low > limit:
            break  # every page left is at least as far
        if tree["leaf"][page]:
            a, b = tree["begin"][page], tree["begin"][page + 1]
            near = np.flatnonzero(np.abs(tree["to_center"][a:b] - d) <= limit) + a  # by the stored distance to the page's center
            near = near[tree["ids"][near] != own]
            if not len(near):
                continue
            scores = tree["rows"][near] @ q
            if len(near) > k:
                cut = np.partition(scores, len(near) - k)[len(near) - k]
                near, scores = near[scores >= cut], scores[scores >= cut]
            for s, i in zip(scores.tolist(), tree["ids"][near].tolist(), strict=True):
                if bound is not None and s < bound:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
            continue
        for child in tree["children"][page]:
            if abs(d - tree["to_parent"][child]) - tree["radius"][child] > limit:
                continue  # the bound between parent distances spares the computation
            to_child = np.sqrt(max(float(norm + top - 2 * int(tree["center"][child] @ q)), 0.0))
            if (least := max(0.0, to_child - tree["radius"][child])) <= limit:
                heapq.heappush(queue, (least, child, to_child))
    return best


def _search(pairs: DataFrame, trees: DataFrame, k: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each tree for every query sent to its routing object."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                dims, parent = r.dims, list(r.parent)
                tree = {"leaf": list(r.leaf), "radius": list(r.radius), "to_parent": list(r.to_parent), "center": np.frombuffer(r.center, np.int64).reshape(-1, dims), "rows": np.frombuffer(r.rows, np.int64).reshape(-1, dims), "to_center": np.frombuffer(r.to_center, float)}
                tree["ids"] = np.concatenate([np.asarray(x, np.int64) for x in r.ids])
                tree["begin"] = np.cumsum([0, *[len(x) for x in r.ids]]).tolist()
                tree["children"] = [[] for _ in parent]
                for child, p in enumerate(parent):
                    if p >= 0:
                        tree["children"][p].append(child)
                vectors, out = np.frombuffer(r.vectors, np.int64).reshape(-1, dims), []
                for q, own, bound in zip(vectors, r.queries, r.bounds, strict=True):
                    bound = None if bound is None or bound != bound else int(bound)
                    out += [(own, -i, s) for s, i in _best_first(q, own, k, bound, tree, top)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return pairs.join(trees, "route").mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries, k: int = 5, routes: int = ROUTES, tree: int = TREE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query with the other rows.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id.
    Equal scores go to the smaller vec_id; with fewer other rows all are
    returned; an empty table gives no rows. See ``scaled`` for rows left out.
    """
    made = index(scaled(vectors), routes, tree)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, trees, centers, lifts, balls, top, dims = made

    def send(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), TOGETHER):
                    part = batch.iloc[start : start + TOGETHER]
                    q = _matrix(part["v"], dims)
                    square = (q * q).sum(1)
                    away = np.sqrt(np.maximum(square[:, None] + top - 2 * (q @ centers.T), 0).astype(float))
                    least = np.maximum(away - balls, 0.0)
                    bounds = [None if pd.isna(b) else int(b) for b in part["bound"]]
                    if first:
                        least = np.where(np.isneginf(balls), np.inf, away)
                        sent = np.arange(len(centers)) == np.argmin(least, 1)[:, None]
                    else:
                        slack = 1e-6 * (np.sqrt(float(top)) + np.sqrt(square.astype(float)) + 1.0)
                        limit = np.array([np.inf if b is None else np.sqrt(max(float(int(s) + top - 2 * b), 0.0)) + x for b, s, x in zip(bounds, square, slack, strict=True)])
                        sent = (least <= limit[:, None]) & ~np.isneginf(balls)
                    ids = part["vec_id"].to_numpy()
                    out = [(j, ids[on].tolist(), q[on].tobytes(), [bounds[i] for i in np.flatnonzero(on)]) for j in range(len(centers)) if (on := sent[:, j]).any()]
                    yield pd.DataFrame(out, columns=["route", "queries", "vectors", "bounds"])

        return run

    kind = "route int, queries array<long>, vectors binary, bounds array<long>"
    asked = rows.filter(queries)
    nearest = asked.withColumn("bound", F.lit(None).cast("long")).mapInPandas(send(True), kind)
    probe = _search(nearest, trees.filter("part = 0"), k, top)
    kth = durable(probe.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "bound"))
    pairs = asked.join(kth, "vec_id", "left").mapInPandas(send(False), kind)
    found = _search(pairs, trees, k, top)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """with v as (select vec_id, min(list_transform(embedding, lambda x: floor(256.0::double * x::double))) v from embeddings
   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
 s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
 select query_id, rank::integer rank, vec_id, score from r where rank <= 5"""


@query("op4_metric_tree", "embeddings", sql=SQL)
def op4(embeddings: DataFrame) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return top_k(embeddings, F.col("vec_id") % 50 == 0)
