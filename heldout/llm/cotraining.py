"""Quality classifier by co-training of a text view and a page-metadata view.

Each view has a logistic model. In every round each model scores all documents
without a label, source by source the surest ones get its label, and the other
model learns from them. On labelled documents kept aside both are calibrated,
and a third small model of the calibrated log-odds scores every document. The
views are computed once and written; the rounds read no text.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import durable
from heldout.operators.ranking import top_k

from .registry import query

#: Labelled documents that the models learn from, drawn by a hash of the id; hashed character features.
LABELLED, BUCKETS = 12_000, 64
#: Rounds, and labels that a view hands over in each: the surest of all documents, but at most this share of them.
ROUNDS, GIVEN, TAKEN = 4, 120, 0.02
FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


def text_view(data: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams as shares under a square root; how many there are, how many differ, how they concentrate, and how words repeat."""
    out = np.zeros(BUCKETS + 13)
    if len(data) > 2:
        x = data.astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        fine = np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(18), minlength=1 << 14)
        share = fine.reshape(BUCKETS, -1).sum(1) / len(code)
        some = fine[fine > 0] / len(code)
        out[:BUCKETS] = np.sqrt(share)
        shape = np.array([np.log(len(code)), np.log(len(some)), -(some * np.log(some)).sum(), np.log(some.max())])
        new = shape[1] - shape[0]  # log share of trigrams that are new
        words = data.tobytes().split()
        twice = sum(map(operator.eq, words, words[1:])) / max(1, len(words))  # words that follow themselves
        kinds = np.log(len(set(words)) / max(1, len(words)) + 1e-9) if words else 0.0
        out[BUCKETS:] = [*shape, *shape[1:] * shape[0] / 8, new, new * new, new * shape[0] / 8, twice, kinds, kinds * shape[0] / 8]
    return out


def meta_view(data: np.ndarray, lang, source, n_chars) -> np.ndarray:
    """Source, language, recorded length and layout: lines, blanks, capitals, digits, marks and symbols."""
    seen = np.bincount(data, minlength=256) if len(data) else np.zeros(256)
    size = max(1, len(data))
    lines, blanks = seen[10] + 1, seen[32] + seen[9] + seen[10] + seen[13]
    layout = [np.log1p(n_chars or 0) / 10, np.log(lines) / 5, np.log1p(size / lines) / 5, blanks / size, seen[65:91].sum() / size, seen[48:58].sum() / size, (seen[33] + seen[63]) / size, sum(seen[b] for b in b"#*$%&|<>") / size, sum(seen[b] for b in b".,;:") / size]
    hot = np.zeros(24)
    hot[sum(map(ord, str(lang))) % 8] = hot[8 + sum(ord(c) * (i + 1) for i, c in enumerate(str(source))) % 16] = 0.3
    return np.concatenate([np.array(layout) * 3, hot])


def _views(text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return text_view(data), meta_view(data, lang, source, n_chars)


@dataclass
class Logistic:
    """Regularised logistic regression; ``scale`` and ``shift`` calibrate its log-odds."""

    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 15) -> Logistic:
        middle, spread = x.mean(0), x.std(0) + 1e-3
        z = np.c_[(x - middle) / spread, np.ones(len(x))]
        # both classes weigh the same
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        w = np.zeros(z.shape[1])
        ridge = np.r_[np.full(x.shape[1], penalty), 1e-6]
        for _ in range(steps):  # Newton steps on a bounded number of features
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        return Logistic(w, middle, spread)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) / self.spread) @ self.weights[:-1] + self.weights[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * self.raw(x) + self.shift, -12, 12)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Two parameters by Newton steps on rows that it has not learned from, with targets held off 0 and 1."""
        r = self.raw(x)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
            g, v = p - t, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(v * r * r).sum() + 1e-3, (v * r).sum()], [(v * r).sum(), v.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [(g * r).sum(), g.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.scale, self.shift = max(a, 1e-3), b


@dataclass
class Blend:
    """Both views and the lower of their log-odds, weighed on the rows that calibrated them."""

    views: tuple[Logistic, Logistic]
    mix: Logistic | None = None

    def inputs(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        a, b = self.views[0].odds(x), self.views[1].odds(m)
        return np.c_[a, b, np.minimum(a, b)]

    def odds(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        z = self.inputs(x, m)
        return np.clip(self.mix.raw(z), -12, 12) if self.mix else z[:, :2].mean(1)


Views = tuple[np.ndarray, np.ndarray]
#: What a view is sure of: the features that the other view sees, and the labels.
Given = tuple[np.ndarray, np.ndarray]


def co_train(views: Views, y: np.ndarray, surest: Callable[[list[Logistic], float], tuple[Given, Given]], rounds: int = ROUNDS) -> Blend:
    """Fit on two thirds of the labelled rows plus exchanged pseudo-labels; calibrate on the last third."""
    third = np.arange(len(y)) % 3 == 2
    if len(set(y[third])) < 2 or len(set(y[~third])) < 2:
        third = np.zeros(len(y), bool)
    own = [[(v[~third], y[~third])] for v in views]
    models = [Logistic.fit(v[~third], y[~third]) for v in views]
    for _ in range(rounds):
        given = surest(models, y.mean())
        for k in (0, 1):  # what one is sure of teaches the other
            own[k].append(given[1 - k])
        models = [Logistic.fit(np.concatenate([x for x, _ in o]), np.concatenate([t for _, t in o])) for o in own]
    for k, m in enumerate(models):
        m.calibrate(views[k][third] if third.any() else views[k], y[third] if third.any() else y)
    blend = Blend((models[0], models[1]))
    if third.any():
        blend.mix = Logistic.fit(blend.inputs(views[0][third], views[1][third]), y[third], 1e-3)
    return blend


WIDTHS = {"x": BUCKETS + 13, "m": 33}
SEEN = "doc_id long, source string, some boolean, x binary, m binary, q int"


def _stack(rows: list, c: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, WIDTHS[c]).astype(float)


def seen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Both views of every row, ``some`` for texts that are not empty, and ``q``, the label of the at most about LABELLED drawn ids."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    share = int((1 << 30) * min(1.0, LABELLED / max(1, known.count())))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < share)
    # size bound: LABELLED in the mean
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *FIELDS[1:]).join(F.broadcast(drawn), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                texts = [t.as_py() for t in part.column(1)]
                both = [_views(t, lang.as_py(), source.as_py(), n.as_py()) for t, lang, source, n in zip(texts, part.column(2), part.column(3), part.column(4), strict=True)]
                x, m = (pa.array([v[k].astype(np.float32).tobytes() for v in both], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([bool(t) for t in texts]), x, m, part.column(5)], names=["doc_id", "source", "some", "x", "m", "q"])

    return durable(rows.select(*FIELDS, F.col("_quality").cast("int").alias("q")).mapInArrow(run, SEEN))


def _exchange(free: DataFrame, free_rows: int) -> Callable[[list[Logistic], float], tuple[Given, Given]]:
    """Rounds over all unlabelled rows: per view and label the surest of every source in turn; only their bounded number comes to the driver."""
    used: list[tuple[int, int]] = []  # at most 2 x GIVEN a round
    most = min(GIVEN, int(TAKEN * free_rows))

    def surest(models: list[Logistic], good: float) -> tuple[Given, Given]:
        wanted = (max(1, round(most * good)), max(1, round(most * (1 - good))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                odds = [models[k].raw(_stack(b.column(3 + k).to_pylist(), c)) for k, c in enumerate("xm")]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(o) for o in odds]], names=["doc_id", "mark", "source", "a", "b"])

        done = free.sparkSession.createDataFrame(used, "doc_id long, mark long")
        rows = free.join(F.broadcast(done), ["doc_id", "mark"], "left_anti")  # size bound: 2 x GIVEN a round
        odds = rows.select("doc_id", "mark", "source", "x", "m").mapInArrow(run, "doc_id long, mark long, source string, a double, b double")
        kinds = F.array(*[F.struct(F.lit(k).alias("view"), F.lit(label).alias("label"), (F.col(c) * sign).alias("far")) for k, c in enumerate("ab") for label, sign in ((1, -1.0), (0, 1.0))])
        each = odds.select("doc_id", "mark", "source", F.explode(kinds).alias("k")).select("doc_id", "mark", "source", "k.*")
        turn = top_k(each, ["view", "label", "source"], ["far", "doc_id", "mark"], max(wanted), "turn")
        first = top_k(turn, ["view", "label"], ["turn", "far", "doc_id", "mark"], max(wanted), "place")
        chosen = first.filter(F.col("place") <= F.when(F.col("label") == 1, wanted[0]).otherwise(wanted[1]))
        listed = sorted(tuple(r) for r in chosen.select("view", "label", "place", "doc_id", "mark").collect())
        ids = free.sparkSession.createDataFrame(sorted({r[3:] for r in listed}), "doc_id long, mark long")
        found = {(r["doc_id"], r["mark"]): r for r in free.join(F.broadcast(ids), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).collect()}
        used.extend(found)
        mine = [[r for r in listed if r[0] == k] for k in (0, 1)]
        return tuple((_stack([found[r[3:]]["mx"[k]] for r in mine[k]], "mx"[k]), np.array([float(r[1]) for r in mine[k]])) for k in (0, 1))

    return surest


def _none(models: list[Logistic], good: float) -> tuple[Given, Given]:
    return (np.empty((0, WIDTHS["m"])), np.empty(0)), (np.empty((0, WIDTHS["x"])), np.empty(0))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score (0..1) and kept (score of one half or more) of every document.

    Documents without text score 0 and are not kept. Rows are scored one by
    one, so repeated rows agree; NULLs in other columns count as a value of
    their own or as 0. Labels may repeat (the lowest counts); if they lack a
    class, all texts score one half. With fewer than 1 / TAKEN unlabelled rows
    nothing is exchanged.
    """
    table = seen(docs, labels)
    known = sorted(table.filter("q is not null").select("doc_id", "x", "m", "q").collect(), key=lambda r: (r["doc_id"], r["x"]))
    views, y = tuple(_stack([r[c] for r in known], c) for c in "xm"), np.array([float(r["q"] > 0) for r in known])
    free = table.filter("q is null and doc_id is not null").withColumn("mark", F.xxhash64("x", "m"))
    blend = None
    if len(set(y)) == 2:
        n = free.count()
        blend = co_train(views, y, _exchange(free, n) if TAKEN * n >= 1 else _none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = (_stack(b.column(k).to_pylist(), c) for k, c in ((2, "x"), (3, "m")))
            odds = [blend.views[0].odds(x), blend.views[1].odds(m), blend.odds(x, m)] if blend else [np.zeros(b.num_rows)] * 3
            some = np.array(b.column(1).to_pylist(), bool)
            p = [np.where(some, 1 / (1 + np.exp(-o)), 0.0) for o in odds]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in p], pa.array(p[2] >= 0.5)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return table.select("doc_id", "some", "x", "m").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


@query("op8_cotraining", "documents", "labels")
def op8(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document."""
    return scored(documents, labels)
