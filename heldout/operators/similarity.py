"""Cosine joins over sparse unit vectors, with bounds that spare most pairs.

Dimensions are numbered by falling mass. The first ``HEAD`` weights of a vector
and the norm of all others make its sketch, again of length one, and the product
of two sketches is never below the cosine. Vectors live in rings around centres
of the sketch space; by the triangle inequality of angles a vector visits only
the rings that can hold what it looks for, there meets only the members whose
sketch product allows it, and of those alone the rest of the weights is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .durable import discard, durable, small
from .ranking import positions

#: Dimensions of a sketch; centres at most, and vectors each stands for; vectors that centres are drawn from; vectors of a ring; steps of an angle.
HEAD, CENTRES, PER_CENTRE, DRAWN, RING, STEPS = 128, 256, 512, 2048, 512, 1024
#: Where all pairs are multiplied: items of a block at most, and least ones; blocks of a small table; dimensions at a time; blocks a vector meets in a round.
BLOCK, LEAST, BLOCKS, SLICE, VISITED = 16_384, 512, 12, 512, 4
#: Slack of angles and cosines, far above rounding.
SLACK = 1e-7


def trigram_weights(df: DataFrame, item: str, text: str) -> DataFrame:
    """Unit-length character trigram counts in sparse form (item, tri, weight)."""
    c = df.select(item, F.explode(trigrams(F.col(text))).alias("tri")).groupBy(item, "tri").agg(F.count(F.lit(1)).alias("_n"))
    n = c.groupBy(item).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_l"))
    return c.join(n, item).select(item, "tri", (F.col("_n") / F.col("_l")).alias("weight"))


def sketches(weights: DataFrame, item: str, feature: str, weight: str) -> DataFrame:
    """(item, sketch, dims, rest): the sketch, and the numbers and weights of the dimensions beyond it."""
    head = HEAD
    mass = weights.groupBy(feature).agg(F.sum(F.col(weight) * F.col(weight)).alias("_m"))
    numbered = small(positions(mass, [], [F.col("_m").desc(), feature], "_d").select(feature, "_d"))
    entry = F.struct(F.col("_d"), F.col(weight).cast("double").alias("w"))
    packed = weights.join(numbered, feature).groupBy(item).agg(F.collect_list(entry).alias("_e"))  # one entry per distinct feature of an item
    first = F.filter("_e", lambda e: e["_d"] < head)
    packed = packed.select(item, F.map_from_entries(first).alias("_h"), F.array_sort(F.filter("_e", lambda e: e["_d"] >= head)).alias("_t"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(head - 1).cast("long")), lambda d: F.coalesce(F.element_at("_h", d), F.lit(0.0)))
    left = F.sqrt(F.aggregate("_t", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    return packed.select(item, F.concat(dense, F.array(left)).alias("sketch"), F.transform("_t", lambda e: e["_d"]).alias("dims"), F.transform("_t", lambda e: e["w"]).alias("rest"))


def _centres(vectors: DataFrame, item: str) -> np.ndarray:
    """Sketches far from one another, taken in turn from a bounded sample by hash; they only steer the work."""
    n = vectors.count()
    wanted = max(1, min(CENTRES, -(-n // PER_CENTRE)))
    share = min(1.0, DRAWN / max(1, n))
    drawn = vectors.filter(F.pmod(F.xxhash64(F.lit(5), item), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select(item, "sketch")
    sample = np.array([r["sketch"] for r in drawn.orderBy(F.xxhash64(F.lit(5), item), item).limit(2 * DRAWN).collect()], float).reshape(-1, HEAD + 1)
    if not len(sample):
        return np.zeros((0, HEAD + 1))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(wanted, len(sample)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[chosen]


def _angles(sketch: pd.Series, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.vstack(sketch.to_numpy()) @ centres.T, -1.0, 1.0))


def ringed(vectors: DataFrame, item: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(vectors with ``home`` and ``ring``; rings with their least and largest angle and number of members; centres).

    A ring is a stretch of angles around its home centre with about ``RING``
    members; where one step of angles has many more, a hash cuts it.
    """
    centres = _centres(vectors, item)

    @F.pandas_udf("struct<home:int,angle:double>")
    def nearest(sketch: pd.Series) -> pd.DataFrame:
        a = _angles(sketch, centres)
        return pd.DataFrame({"home": a.argmin(axis=1).astype("int32"), "angle": a.min(axis=1)})

    placed = durable(vectors.withColumn("_p", nearest("sketch")).select("*", "_p.home", "_p.angle").drop("_p"))
    step = F.floor(F.col("angle") * STEPS).cast("int")
    counts = placed.groupBy("home", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))  # at most centres x STEPS x pi rows
    before = F.sum("n").over(W.partitionBy("home").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    table = counts.select("home", "step", F.floor(F.coalesce(before, F.lit(0)) / RING).alias("band"), F.ceil(F.col("n") / RING).alias("cuts"))
    both = placed.withColumn("step", step).join(small(table, rows=1_000_000), ["home", "step"])
    cut = F.when(F.col("cuts") > 1, F.pmod(F.xxhash64(item), F.col("cuts"))).otherwise(F.lit(0))
    alone = F.when(F.col("cuts") > 1, F.col("step")).otherwise(F.lit(-1))
    name = F.concat_ws("-", "home", "band", alone.cast("string"), cut.cast("string"))
    rows = durable(both.select(*placed.columns, name.alias("ring")))
    discard(placed)
    rings = durable(rows.groupBy("ring", "home").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count(F.lit(1)).alias("members")))
    return rows, rings, centres


def _rest_products(a: pd.DataFrame, c: pd.DataFrame, r: np.ndarray, k: np.ndarray, slice_: int = 512, pairs: int = 8192) -> np.ndarray:
    """Products of the weights beyond the sketch for the pairs (r, k), some dimensions and pairs at a time."""
    out = np.zeros(len(r))
    used_a, used_c = np.unique(r), np.unique(k)

    def entries(d: pd.DataFrame, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dims, rest = d["dims"].to_numpy()[used], d["rest"].to_numpy()[used]
        sizes = [len(x) for x in dims]
        flat = lambda xs: np.concatenate(xs) if len(xs) else np.empty(0)
        return np.repeat(np.arange(len(used)), sizes), flat(dims).astype(np.int64), flat(rest).astype(float)

    (ra, da, wa), (rc, dc, wc) = entries(a, used_a), entries(c, used_c)
    shared = np.intersect1d(da, dc)
    at, ct = np.searchsorted(used_a, r), np.searchsorted(used_c, k)
    for s in range(0, len(shared), slice_):
        dims = shared[s : s + slice_]

        def dense(rows, d, w, n):
            m, place = np.zeros((n, len(dims))), np.searchsorted(dims, d)
            ok = (place < len(dims)) & (dims[np.minimum(place, len(dims) - 1)] == d)
            m[rows[ok], place[ok]] = w[ok]
            return m

        x, y = dense(ra, da, wa, len(used_a)), dense(rc, dc, wc, len(used_c))
        if 4 * len(r) > len(used_a) * len(used_c):  # most pairs: one matrix product is less work
            out += (x @ y.T)[at, ct]
            continue
        for p in range(0, len(r), pairs):
            out[p : p + pairs] += np.einsum("ij,ij->i", x[at[p : p + pairs]], y[ct[p : p + pairs]])
    return out


def _looked(a: pd.DataFrame, c: pd.DataFrame, item: str, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of c, cosines) of the pairs of different items whose sketches allow at least ``least`` of the row of a."""
    bound = np.vstack(a["sketch"].to_numpy()) @ np.vstack(c["sketch"].to_numpy()).T
    keep = bound >= least[:, None] - SLACK
    keep &= a[item].to_numpy()[:, None] != c[item].to_numpy()[None, :]
    r, k = np.nonzero(keep)
    x, y = np.vstack(a["sketch"].to_numpy())[:, :-1], np.vstack(c["sketch"].to_numpy())[:, :-1]
    first = (x @ y.T)[r, k]
    return r, k, first + _rest_products(a, c, r, k)


def _home_best(rows: DataFrame, item: str, kind: str) -> DataFrame:
    """The largest cosine of each vector within its own ring: what a search need not go below."""

    def run(c: pd.DataFrame) -> pd.DataFrame:
        bound = np.vstack(c["sketch"].to_numpy())
        bound = bound @ bound.T
        np.fill_diagonal(bound, -1.0)
        # the member with the best bound gives a true cosine to start from
        best = bound.argmax(axis=1)
        r = np.arange(len(c))
        x = np.vstack(c["sketch"].to_numpy())[:, :-1]
        cos = np.einsum("ij,ij->i", x, x[best]) + _rest_products(c, c, r, best)
        return pd.DataFrame({item: c[item], "known": np.where(best == r, -1.0, cos)})

    return rows.groupBy("ring").applyInPandas(run, f"`{item}` {kind}, known double")


def visits(rows: DataFrame, rings: DataFrame, centres: np.ndarray, item: str, piece: int = 65_536) -> DataFrame:
    """(item, least, sketch, dims, rest, ring) of every ring that may hold a cosine of ``least`` or more with the item.

    The angle to a member is at least the difference of both angles to the member's home centre.
    """

    reach = rings.groupBy("home").agg(F.min("least").alias("least"), F.max("most").alias("most"))  # one row per centre
    lo, hi = np.full(len(centres), 9.0), np.full(len(centres), -9.0)
    for r in reach.collect():
        lo[r["home"]], hi[r["home"]] = r["least"], r["most"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = _angles(b["sketch"], centres)
            width = np.arccos(np.clip(b["least"].to_numpy() - SLACK, -1.0, 1.0))[:, None] + SLACK
            r, h = np.nonzero((a + width >= lo[None, :]) & (a - width <= hi[None, :]))
            low, high, slim = a - width, a + width, b.drop(columns="sketch")
            for p in range(0, len(r), piece):  # a vector may visit every centre
                x, y = r[p : p + piece], h[p : p + piece]
                out = slim.iloc[x].reset_index(drop=True)
                out["to_home"], out["from_"], out["until"] = y.astype("int32"), low[x, y], high[x, y]
                yield out

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in (item, "least")]
    slim = rows.select(item, "least", "sketch")
    each = slim.mapInPandas(run, ", ".join([*names, "to_home int", "from_ double", "until double"]))
    table = rings.select("ring", F.col("home").alias("to_home"), F.col("least").alias("_lo"), F.col("most").alias("_hi"))
    return each.join(small(table), "to_home").filter("until >= _lo and from_ <= _hi").select(item, "ring")


def _meet(rows: DataFrame, rings: DataFrame, centres: np.ndarray, item: str, kernel, schema: str, block: int = 2048) -> DataFrame:
    """Run ``kernel(visitors, members)`` on bounded blocks of the visitors of each ring."""
    seen = durable(visits(rows, rings, centres, item))
    per_ring = seen.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    per_ring = small(per_ring)
    left = seen.join(per_ring, "ring").select(item, "ring", F.pmod(F.xxhash64(F.lit(3), item), F.col("_nb")).cast("int").alias("_b"))
    left = left.join(rows.drop("ring", "home", "angle"), item)
    right = rows.drop("home", "angle", "least").join(per_ring, "ring").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # own attributes for the second side

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, c)

    return left.groupBy("ring", "_b").cogroup(right.groupBy("ring", "_b")).applyInPandas(run, schema)


def closest_pair(weights: DataFrame, item: str, feature: str, weight: str) -> DataFrame:
    """The pair of items with the largest cosine; the smaller ids win a tie. Items without a feature take no part.

    The best pair inside rings bounds the search from below, so few pairs remain elsewhere.
    """
    kind = weights.schema[item].dataType.simpleString()
    rows, rings, centres = ringed(sketches(weights, item, feature, weight), item)
    known = _home_best(rows, item, kind).agg(F.max("known")).first()[0]
    rows = rows.withColumn("least", F.lit(float(-1.0 if known is None else known)))

    def kernel(a, c):
        if a.empty or c.empty:
            return pd.DataFrame(columns=["i", "j", "cosine"])
        r, k, cos = _looked(a, c, item, a["least"].to_numpy())
        x, y = a[item].to_numpy()[r], c[item].to_numpy()[k]
        cos = np.where(x < y, np.round(cos, 12), -np.inf)
        if not len(cos) or cos.max() == -np.inf:
            return pd.DataFrame(columns=["i", "j", "cosine"])
        top = cos == cos.max()
        i, j = min(zip(x[top], y[top]))
        return pd.DataFrame([[i, j, cos.max()]], columns=["i", "j", "cosine"])

    best = _meet(rows, rings, centres, item, kernel, f"i {kind}, j {kind}, cosine double")
    return best.agg(F.max_by(F.struct("i", "j", "cosine"), F.struct("cosine", -F.col("i"), -F.col("j"))).alias("_b")).select("_b.*")


def _every_cosine(tables: list[pa.Table], item: str, copies: str, features: int, threshold: float, row_tile: int = 1024, column_tile: int = 4096) -> pa.Table:
    """Per item of both blocks (or of one, with itself): items above the threshold, their copies, and the largest cosine.

    Tiles are multiplied in single precision. What lies within its error of the
    threshold, or of the largest of a row or a column, is multiplied again in
    double precision; a tile with much of that as a whole.
    """
    blocks = []
    for t in tables:
        sizes = np.asarray(pc.list_value_length(t["dims"]))
        flat = lambda c: np.asarray(pc.list_flatten(t[c]))
        blocks.append((np.concatenate([[0], np.cumsum(sizes)]), flat("dims"), flat("weights"), np.asarray(t[copies]), sizes.max(initial=0)))
    alone = len(tables) == 1
    ids = pa.chunked_array([chunk for t in tables for chunk in t[item].chunks], tables[0][item].type)
    tables.clear()
    x, y = blocks[0], blocks[-1]
    error = 2.0**-22 * (min(x[4], y[4]) + 8)  # sums of rounded products of unit vectors, twice over
    found = [(np.zeros(len(b[3]), np.int64), np.zeros(len(b[3]), np.int64), np.full(len(b[3]), -np.inf)) for b in blocks]
    (ns, ws, best), (nt, wt, top) = found[0], found[-1]

    def dense(b, rows: range, first: int, kind) -> np.ndarray:
        at = slice(b[0][rows.start], b[0][rows.stop])
        r, d, w = np.repeat(np.arange(len(rows)), np.diff(b[0][rows.start : rows.stop + 1])), b[1][at], b[2][at]
        if features > SLICE:
            ok = d // SLICE == first // SLICE
            r, d, w = r[ok], d[ok] - first, w[ok]
        m = np.zeros((len(rows), min(features, SLICE)), kind)
        m[r, d] = w
        return m

    def product(rows: range, columns: range, kind, known: np.ndarray | None = None) -> np.ndarray:
        out = 0.0
        for first in range(0, features, SLICE):
            out = out + dense(x, rows, first, kind) @ (dense(y, columns, first, kind) if known is None else known).T
        return out

    def exact(rows: range, columns: range, r: np.ndarray, k: np.ndarray, pairs: int = 2048) -> np.ndarray:
        out = np.zeros(len(r))
        for first in range(0, features, SLICE):
            u, v = dense(x, rows, first, float), dense(y, columns, first, float)
            for p in range(0, len(r), pairs):
                out[p : p + pairs] += np.einsum("ij,ij->i", u[r[p : p + pairs]], v[k[p : p + pairs]])
        return out

    for c in range(0, len(y[3]), column_tile):
        columns = range(c, min(c + column_tile, len(y[3])))
        known = dense(y, columns, 0, np.float32) if features <= SLICE else None
        for a in range(0, len(x[3]), row_tile):
            rows = range(a, min(a + row_tile, len(x[3])))
            r_, c_ = slice(rows.start, rows.stop), slice(columns.start, columns.stop)
            same = np.arange(max(rows.start, columns.start), min(rows.stop, columns.stop)) if alone else np.empty(0, int)
            cos = product(rows, columns, np.float32, known)
            cos[same - a, same - c] = -2.0
            again = cos >= (np.maximum(best[r_], cos.max(axis=1)) - error).astype(np.float32)[:, None]
            if not alone:
                again |= cos >= (np.maximum(top[c_], cos.max(axis=0)) - error).astype(np.float32)[None, :]
            near = cos > np.float32(threshold - error)
            if near.any():
                unsure = near & (cos < np.float32(threshold + error))
                again |= unsure
                near &= ~unsure
            r, k = np.nonzero(again)
            if len(r) > 8 * sum(cos.shape):
                cos = product(rows, columns, float)
                cos[same - a, same - c] = -2.0
                near = cos > threshold
                best[r_] = np.maximum(best[r_], cos.max(axis=1))
                if not alone:
                    top[c_] = np.maximum(top[c_], cos.max(axis=0))
            else:
                value = exact(rows, columns, r, k)
                value[cos[r, k] < -1.5] = -np.inf  # an item and itself
                near[r, k] = value > threshold
                np.maximum.at(best, r + a, value)
                if not alone:
                    np.maximum.at(top, k + c, value)
            if near.any():
                ns[r_] += near.sum(axis=1)
                ws[r_] += near @ y[3][c_]
                if not alone:
                    nt[c_] += near.sum(axis=0)
                    wt[c_] += x[3][r_] @ near
    n, w, b = (np.concatenate(z) for z in zip(*found))
    looked = np.concatenate([np.full(len(z[3]), len(o[3]) - alone) for z, o in zip(blocks, reversed(blocks))])
    return pa.table({item: ids, "similar_items": n, "similar_weight": w, "nearest": np.where(b < -1.5, -np.inf, b), "looked": looked.astype(np.int64)})


def _nearest_of_all(weights: DataFrame, items: DataFrame, item: str, feature: str, weight: str, copies: str, threshold: float) -> DataFrame:
    """Sums of ``_every_cosine`` over all pairs of blocks of hashed items, in rounds that give a vector to ``VISITED`` pairs or so each.

    Work is quadratic in the items; a task holds two blocks, and a round's shuffle is a few times the vectors.
    """
    kind = weights.schema[item].dataType.simpleString()
    named = weights.select(feature).distinct()
    numbered = durable(positions(named, [], [feature], "_d").select(feature, F.col("_d").cast("int").alias("_d")))
    features = numbered.count()
    entry = F.struct(F.col("_d"), F.col(weight).cast("double").alias("w"))
    packed = weights.join(small(numbered), feature).groupBy(item).agg(F.collect_list(entry).alias("_e"))  # one entry per distinct feature of an item
    packed = packed.select(item, F.transform("_e", lambda e: e["_d"].cast("short" if features < 1 << 15 else "int")).alias("dims"), F.transform("_e", lambda e: e["w"]).alias("weights"))
    rows = durable(packed.join(items.select(item, F.col(copies).cast("long").alias(copies)), item))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(BLOCKS, -(-n // LEAST)))
    mine = F.pmod(F.xxhash64(F.lit(3), item), F.lit(blocks)).cast("int")
    each = rows.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.withColumn("_pair", F.least("_b", "_o") * F.lit(blocks) + F.greatest("_b", "_o"))
    rounds = -(-blocks // VISITED)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ends = sorted({key[0].as_py() // blocks, key[0].as_py() % blocks})
        both = [t for t in (table.filter(pc.equal(table["_b"], e)).drop_columns(["_b"]).combine_chunks() for e in ends)]
        if not all(t.num_rows for t in both):
            both = []
        out = _every_cosine(both, item, copies, features, threshold) if both else None
        return out if out is not None else pa.table({item: table[item].slice(0, 0), "similar_items": pa.array([], pa.int64()), "similar_weight": pa.array([], pa.int64()), "nearest": pa.array([], pa.float64()), "looked": pa.array([], pa.int64())})

    schema = f"`{item}` {kind}, similar_items long, similar_weight long, nearest double, looked long"
    parts = []
    for k in range(rounds):
        sent = each.filter(F.pmod(F.col("_b") + F.col("_o"), F.lit(rounds)) == k).drop("_o").repartition(min(2000, 2 * blocks * blocks // rounds + 1), "_pair")
        parts.append(durable(sent.groupBy("_pair").applyInArrow(run, schema)))
    part = parts[0]
    for more in parts[1:]:
        part = part.unionByName(more)
    out = part.groupBy(item).agg(F.sum("similar_items").alias("similar_items"), F.sum("similar_weight").alias("similar_weight"), F.max("nearest").alias("nearest"), F.sum("looked").alias("looked"))
    return out.filter("nearest > 0")


def neighbour_profile(weights: DataFrame, items: DataFrame, item: str, feature: str, weight: str, copies: str, threshold: float, all_rows: bool = False, nearest_of_all: bool = False) -> DataFrame:
    """Per item: how many other items lie above the threshold, their copies, the nearest cosine, and pairs looked at.

    Exact; items without any other above the threshold have no row
    unless ``all_rows`` asks for those that looked at some. With
    ``nearest_of_all`` every item that shares a feature with another one has
    its row and the cosine of its nearest one, however far; bounds spare little
    of that, so all pairs are multiplied. No pair leaves its
    task, so a large group of near copies costs arithmetic, not rows.
    """
    if nearest_of_all:
        return _nearest_of_all(weights, items, item, feature, weight, copies, threshold)
    kind = weights.schema[item].dataType.simpleString()
    rows, rings, centres = ringed(sketches(weights, item, feature, weight), item)
    rows = durable(rows.join(items.select(item, copies), item).withColumn("least", F.lit(float(threshold))))

    def kernel(a, c):
        cols = [item, "similar_items", "similar_weight", "nearest", "looked"]
        if a.empty or c.empty:
            return pd.DataFrame(columns=cols)
        r, k, cos = _looked(a, c, item, a["least"].to_numpy())
        near, n = cos > threshold, len(a)
        nearest = np.full(n, -np.inf)
        np.maximum.at(nearest, r, cos)
        out = pd.DataFrame({item: a[item].to_numpy(), "similar_items": np.bincount(r[near], minlength=n), "similar_weight": np.bincount(r[near], c[copies].to_numpy()[k[near]], n).astype(np.int64), "nearest": nearest, "looked": np.bincount(r, minlength=n)})
        return out[out["looked"] > 0]

    part = _meet(rows, rings, centres, item, kernel, f"`{item}` {kind}, similar_items long, similar_weight long, nearest double, looked long")
    out = part.groupBy(item).agg(F.sum("similar_items").alias("similar_items"), F.sum("similar_weight").alias("similar_weight"), F.max("nearest").alias("nearest"), F.sum("looked").alias("looked"))
    return out if all_rows else out.filter("similar_items > 0")
