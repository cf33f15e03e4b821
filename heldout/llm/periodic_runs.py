"""Runs of words with a small period, by uniting suffix classes in order of falling common prefixes.

Word suffixes of each text are ranked by doubling; only groups that still hold
several suffixes are sorted again. Neighbours in that order with their common
prefix L are the edges of a spanning forest, taken by falling L: a union-find
joins the classes of suffixes alike in L words, each with its ordered
positions. Two positions that become neighbours at a distance of d <= L have
the period d over d + L words; the pair at the left end of such a stretch
is its run, found once and with its smallest period.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .pieces import cut
from .quality_rules import let
from .registry import WORD, query

#: A run has this many words and this many periods at least. Bytes of text in one suffix order. Positions in a block of an ordered set.
LEAST, TIMES = 6, 4
PIECE, BLOCK = 1 << 20, 512


class Positions:
    """An ordered set of numbers in blocks of bounded length."""

    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, first: int):
        self.blocks, self.lasts, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Add ``x``, which is not there yet; its neighbours, -1 where there is none."""
        b = bisect_left(self.lasts, x)
        self.size += 1
        if b == len(self.lasts):
            b -= 1
            block, before, after = self.blocks[b], self.lasts[b], -1
            block.append(x)
            self.lasts[b] = x
        else:
            block = self.blocks[b]
            k = bisect_left(block, x)
            after, before = block[k], block[k - 1] if k else self.lasts[b - 1] if b else -1
            block.insert(k, x)
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = block[:BLOCK], block[BLOCK:]
            self.lasts.insert(b, block[BLOCK - 1])
        return before, after


def ranks(words: np.ndarray, row: np.ndarray, end: np.ndarray, shortest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks by the first 1, 2, 4, ... words; positions not alone in their first ``shortest`` words, in the last order).

    ``row`` and ``end`` give each position's text and where that ends. A rank
    is the place of its group in the order, so equal ranks mean equal words
    of one text and the order within a group only gets finer.
    """
    total = len(words)
    order = np.argsort(row * (words.max(initial=0) + 1) + words)
    group = np.r_[True, (row[order][1:] != row[order][:-1]) | (words[order][1:] != words[order][:-1])] if total else np.empty(0, bool)
    rank = np.empty(total, np.int64)
    rank[order] = np.maximum.accumulate(np.where(group, np.arange(total), 0))
    levels, width, base = [rank.astype(np.int32)], 1, None
    alone = group & np.r_[group[1:], True] if total else group
    left = order[~alone]
    while len(left):
        if width <= shortest:
            base = left
        ahead = left + width
        follows = np.where(ahead < end[left], rank[np.minimum(ahead, total - 1)] + 1, 0)
        order = np.lexsort((follows, rank[left])) if total > 1 << 31 else np.argsort(rank[left] * (total + 1) + follows)
        left, follows = left[order], follows[order]
        old = rank[left]
        head = np.r_[True, old[1:] != old[:-1]]
        group = head | np.r_[True, follows[1:] != follows[:-1]]
        at = np.arange(len(left))
        rank[left] = old + np.maximum.accumulate(np.where(group, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        width *= 2
        levels.append(rank.astype(np.int32))
        left = left[~(group & np.r_[group[1:], True])]
    if base is None:
        base = np.empty(0, np.int64)
    return levels, base[np.argsort(rank[base])]


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common, from the widest ranks down."""
    done, top = np.zeros(len(a), np.int64), len(end) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y, level = a + done, b + done, levels[k]
        same = (x < end[a]) & (y < end[b])
        same &= level[np.minimum(x, top)] == level[np.minimum(y, top)]
        done += same << k
    return done


def find_runs(words: np.ndarray, row: np.ndarray, end: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` words and ``times`` >= 2 periods or more, in no order."""
    shortest = min(max(least, times * d) - d for d in range(1, least // times + 2))  # prefix that any run's seed has
    levels, suffixes = ranks(words, row, end, shortest)
    if len(suffixes) < 2:
        return []
    prefix = common_prefixes(levels, suffixes[:-1], suffixes[1:], end)
    prefix[row[suffixes[:-1]] != row[suffixes[1:]]] = 0
    # classes alike in the shortest prefix; those whose nearest members lie too far apart for their longest prefix have no run
    joined = prefix >= shortest
    label = np.r_[0, np.cumsum(~joined)]
    order = np.lexsort((suffixes, label))
    near = np.full(label[-1] + 1, len(words), np.int64)
    same = label[order][1:] == label[order][:-1]
    np.minimum.at(near, label[order][1:][same], np.diff(suffixes[order])[same])
    reach = np.zeros(label[-1] + 1, np.int64)
    np.maximum.at(reach, label[1:][joined], prefix[joined])
    edges = np.flatnonzero(joined & ((times - 1) * near <= reach)[label[1:]])
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    up: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    place, word, begins = suffixes.tolist(), words.tolist(), np.r_[True, row[1:] != row[:-1]].tolist()
    runs = []

    def root(i: int) -> int:
        while (above := up.setdefault(i, i)) != i:
            up[i] = up[above]
            i = above
        return i

    def seed(i: int, j: int, alike: int) -> None:
        period = j - i
        if alike + period >= max(least, times * period) and (begins[i] or word[i - 1] != word[j - 1]):
            runs.append((i, alike + period, period))

    for e, alike in zip(edges.tolist(), prefix[edges].tolist(), strict=True):
        a, b = root(e), root(e + 1)
        one, two = (sets.pop(x, None) or Positions(place[x]) for x in (a, b))
        if one.size < two.size:
            a, b, one, two = b, a, two, one
        up[b], sets[a] = a, one
        # an added position is a new neighbour of the larger set's members only
        given = list(two)
        for x, last, then in zip(given, [-1, *given], [*given[1:], -1], strict=False):
            before, after = one.add(x)
            if before >= 0 and before != last:
                seed(before, x, alike)
            if after >= 0 and not 0 <= then < after:
                seed(x, after, alike)
    return runs


RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
ADDED = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
_FIND = re.compile(WORD)


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Documents with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` joins by one blank the words that no run contains after its
    first period. NULL, empty and blank texts have no words, no runs and an
    empty ``collapsed``; texts are looked at one by one, so repeated rows get
    the same and ids do not matter; an empty table gives no rows. Columns named
    like an added one are replaced, all others stay. Memory grows with a piece of
    ``PIECE`` bytes or with one longer text: four bytes a word for each
    doubling of its longest repeated stretch, and some 200 bytes a word of its periodic part.
    """
    new = [f.name for f in ADDED]
    kept = [f for f in docs.schema.fields if f.name not in new]
    rows = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", PIECE):
                texts = [_FIND.findall(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                bounds = np.r_[0, np.cumsum(sizes)]
                words = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
                found: list[list[dict]] = [[] for _ in texts]
                change = np.zeros(len(words) + 1, np.int64)
                row = np.repeat(np.arange(len(texts)), sizes)
                for start, length, period in sorted(find_runs(words, row, bounds[1:][row], least, times), key=lambda r: (r[0], r[2])):
                    k = int(row[start])
                    found[k].append({"start": start - int(bounds[k]), "length": length, "period": period})
                    change[start + period] += 1
                    change[start + length] -= 1
                stays = np.cumsum(change) == 0
                short = [" ".join([t[i] for i in np.flatnonzero(stays[b : b + len(t)])] if f else t) for t, b, f in zip(texts, bounds.tolist(), found, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(found, pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))), pa.array(short, pa.string())], names=["row", *new])

    out = rows.mapInArrow(run, StructType([StructField("row", StructType(kept)), *ADDED]))
    return out.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept], *new)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals."""
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; by the CRC of its decimal id (NULL: of nothing) one text in ten repeats the words from one place on with a period."""
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(code / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda s: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, s["a"] + F.pmod(i - s["a"], s["p"])))), " "))

    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    return docs.select("doc_id", F.when((F.pmod(code, F.lit(10)) == 0) & F.col("text").rlike(WORD), let(words, periodic)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", "documents")
def op12(documents: DataFrame) -> DataFrame:
    """Number and digest of every document's runs, its strongest run, and the digest of what is left without the repeats."""
    out = collapse(planted(documents)).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
