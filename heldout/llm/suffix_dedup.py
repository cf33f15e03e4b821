"""Removing long repeated byte strings by sorted suffixes.

Anchors (the smallest hash of a fixed-width string in each window) cut every
text into regions such that two equal windows have the same anchor at the same
place. Only regions whose anchor occurs twice can hold a repeat; equal regions
are counted, and each distinct one is placed in a block with all that share its
anchor. The suffixes of a block are sorted in two stages: those smaller than
their successor directly, the others induced by scanning the buckets. Common
prefixes of neighbours then tell which windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import durable, small

from .registry import query

LENGTH, WIDTH = 400, 200
#: Bytes scanned for anchors at once, bytes of regions sorted together, distinct regions of one anchor beyond which windows are grouped by hash.
CHUNK, BLOCK, LARGEST = 4 << 20, 1 << 18, 4096
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    one = np.ones(1, np.uint64)
    grow = lambda b: np.cumprod(np.r_[one, np.full(n, b, np.uint64)])
    return [(grow(b), grow(pow(b, -1, 1 << 64))) for b in _ODD]


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Regions of a text: (anchor hash, region hash, first window, number of windows)."""

    def __init__(self, length: int = LENGTH, width: int = WIDTH):
        self.length, self.width, self.powers = length, width, _powers(1 << 16)

    def _chunk(self, data: np.ndarray, offset: int) -> list[np.ndarray]:
        n, k = len(data), self.width
        while len(self.powers[0][0]) <= n:
            self.powers = _powers(2 * len(self.powers[0][0]))
        sums = []
        for up, _ in self.powers:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * up[:n], out=s[1:])
            sums.append(s)
        spot = (sums[0][k:] - sums[0][:-k]) * self.powers[0][1][: n - k + 1]
        key = (_stir(spot) >> np.uint64(24) << np.uint64(24)) | np.arange(n - k + 1, dtype=np.uint64)
        w, windows = self.length - k + 1, n - self.length + 1
        table = np.r_[key, np.full(-len(key) % w, np.uint64((1 << 64) - 1))].reshape(-1, w)
        ahead = np.minimum.accumulate(table, 1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], windows]
        end = last + self.length - 1
        names = [_stir((s[end] - s[first]) * inverse[first]) for s, (_, inverse) in zip(sums, self.powers, strict=True)]
        # the anchor's place in the region belongs to the name, so equal names mean equal regions around the same anchor
        both = names[0] ^ (names[1] * np.uint64(0x9FB21C651E98DF25)) ^ ((place[first] - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        return [_stir(spot[place[first]]).view(np.int64), both.view(np.int64), first + offset, last - first]

    def __call__(self, text: bytes) -> list[np.ndarray]:
        parts = []
        for start in range(0, max(0, len(text) - self.length + 1), CHUNK):
            data = np.frombuffer(text, np.uint8, min(len(text) - start, CHUNK + self.length - 1), start).astype(np.uint64)
            parts.append(self._chunk(data, start))
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4


SCAN = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_bytes", pa.int64()), ("anchor", pa.list_(pa.int64())), ("region", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64()))])


def _scan(docs: DataFrame, length: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, width)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part, rows = batch.slice(start, 500), []
                for t in part.column(1):
                    data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    rows.append((hashlib.sha256(data).hexdigest(), len(data), *anchors(data)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), t) for c, t in zip(columns, SCAN.types[1:], strict=True)]], schema=SCAN)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sha string, n_bytes long, anchor array<long>, region array<long>, first array<long>, windows array<long>")


def suffix_order(text: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at the places ``wanted`` (a mask) in order of their first ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly. The others are
    induced: scanning the buckets upwards, a suffix met puts the one before it,
    if larger, at the head of that one's bucket. Places that only serve the
    induction are added and left out of the result.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    # smaller than the successor: the next different byte is larger (the end counts as smallest)
    change = np.flatnonzero(np.r_[data[1:] != data[:-1], True])
    following = change[np.searchsorted(change, np.arange(n))] + 1
    direct = np.r_[data, np.uint8(0)][following] > data
    direct[following >= n] = False
    need = wanted.copy()
    # a chain of larger suffixes ends at the first direct one (or the text's end)
    stop = np.flatnonzero(direct)
    starts = np.flatnonzero(wanted & ~direct)
    until = np.r_[stop, n - 1][np.searchsorted(stop, starts)]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, until + 1, -1)
    need |= np.cumsum(marks)[:n] > 0
    chosen = np.flatnonzero(need & direct).tolist()
    chosen.sort(key=lambda i: text[i : i + depth])
    size = np.bincount(data[need], minlength=256)
    head = np.r_[0, np.cumsum(size)[:-1]].tolist()
    order = [-1] * int(size.sum())
    lasts = np.bincount(data[chosen] if chosen else np.empty(0, np.uint8), minlength=256)
    at = (np.cumsum(size) - lasts).tolist()
    for i in chosen:  # already in order, so each bucket's end fills upwards
        c = text[i]
        order[at[c]] = i
        at[c] += 1
    induced = (need & ~direct).tolist()
    if induced and induced[n - 1]:  # before all others of its bucket
        c = text[n - 1]
        order[head[c]] = n - 1
        head[c] += 1
    for i in order:  # grows while it is scanned: buckets ahead fill up
        if i > 0 and induced[i - 1]:
            c = text[i - 1]
            order[head[c]] = i - 1
            head[c] += 1
    out = np.array(order, np.int64)
    return out[wanted[out]]


def repeated_windows(regions: list[tuple[bytes, int, bool]], length: int) -> list[np.ndarray]:
    """For each (bytes, number of windows, repeated as a whole): the mask of windows that repeat in the block."""
    text = b"".join(r[0] for r in regions)
    starts = np.cumsum([0, *[len(r[0]) for r in regions]])
    wanted = np.zeros(len(text), bool)
    for s, (_, windows, _) in zip(starts, regions, strict=False):
        wanted[s : s + windows] = True
    order = suffix_order(text, wanted, length)
    same = np.array([text[a : a + length] == text[b : b + length] for a, b in zip(order, order[1:], strict=False)], bool)  # common prefix of neighbours reaches the length
    hit = np.zeros(len(text), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[s : s + windows] | whole for s, (_, windows, whole) in zip(starts, regions, strict=False)]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


FOUND = "anchor long, region long, windows long, starts array<long>, stops array<long>"


def _sorted_blocks(regions: DataFrame, length: int) -> DataFrame:
    """Blocks of whole anchor groups, streamed from partitions sorted by anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush(rows):
            masks = repeated_windows([(r[3], r[2], r[4] > 1) for r in rows], length)
            out = [(r[0], r[1], r[2], *_runs(m)) for r, m in zip(rows, masks, strict=True) if m.any()]
            return pd.DataFrame(out, columns=["anchor", "region", "windows", "starts", "stops"])

        for batch in batches:
            for r in batch.itertuples(index=False, name=None):
                if size >= BLOCK and r[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield flush(held)

    ordered = regions.select("anchor", "region", "windows", "data", "rows").repartition("anchor").sortWithinPartitions("anchor", "region")
    return ordered.mapInPandas(run, FOUND)


def _hashed_windows(regions: DataFrame, length: int) -> DataFrame:
    """The way for anchors with too many distinct regions for one block: equal windows meet by their hash, pre-aggregated."""
    each = regions.select("anchor", "region", "windows", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("w"), "data")
    each = each.select("anchor", "region", "windows", "w", "rows", F.sha2(F.substring(F.col("data"), (F.col("w") + 1).cast("int"), F.lit(length)), 256).alias("h"))
    often = each.groupBy("h").agg(F.sum("rows").alias("n")).filter("n > 1").select("h")
    hits = each.join(often, "h").groupBy("anchor", "region", "windows").agg(F.array_sort(F.collect_set("w")).alias("starts"))
    return hits.select("anchor", "region", "windows", "starts", F.transform("starts", lambda w: w + 1).alias("stops"))


def repeats(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, sha, n_bytes, rows, whole; spans: sha with arrays of begin and end of repeated bytes).

    ``rows`` is the number of rows with this text; ``whole`` says that the text
    repeats as a whole. NULL is the empty text; texts shorter than ``length``
    repeat nothing; repeated rows repeat each other; an empty table gives no
    rows. Regions are told apart by 128 bits of hashes.
    """
    scan = durable(_scan(docs, length, width))
    texts = scan.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("rows"))
    texts = durable(texts.withColumn("whole", (F.col("rows") > 1) & (F.col("n_bytes") >= length)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    keeper = F.coalesce(F.col("keeper").cast("string"), F.lit("")).alias("doc")
    own = scan.select("sha", key, "anchor", "region", "first", "windows").join(texts.select("sha", keeper, "rows"), ["sha", "doc"])
    places = durable(own.dropDuplicates(["sha"]).select(F.xxhash64("sha").alias("text"), "sha", "doc", "rows", F.explode(F.arrays_zip("anchor", "region", "first", "windows")).alias("p")).select("text", "sha", "doc", "rows", "p.*"))
    equal = places.groupBy("anchor", "region", "windows").agg(F.sum("rows").alias("rows"), F.min(F.struct("text", "first")).alias("at"))
    equal = durable(equal)
    crowd = equal.groupBy("anchor").agg(F.count(F.lit(1)).alias("regions"), F.sum("rows").alias("all")).filter("all > 1")
    shared = durable(equal.join(crowd.select("anchor", "regions"), "anchor"))
    alone = shared.filter("regions = 1").select("anchor", "region", "windows", F.array(F.lit(0).cast("long")).alias("starts"), F.array("windows").alias("stops"))
    mixed = shared.filter("regions > 1")
    needed = mixed.select(F.col("at.text").alias("text"), F.struct("at.first", "anchor", "region", "windows", "rows", "regions").alias("r")).groupBy("text").agg(F.collect_list("r").alias("rs"))  # at most the regions of one text
    named = places.select("text", "sha", "doc").distinct()
    source = docs.select(key, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).withColumn("sha", F.sha2("body", 256))
    cut = source.join(needed.join(named, "text").select("sha", "doc", "rs"), ["sha", "doc"]).select(F.explode("rs").alias("r"), "body")
    cut = cut.select("r.*", F.substring(F.col("body"), (F.col("r.first") + 1).cast("int"), (F.col("r.windows") + length - 1).cast("int")).alias("data")).dropDuplicates(["anchor", "region", "windows"])
    cut = durable(cut)
    sorted_ = _sorted_blocks(cut.filter(F.col("regions") <= largest), length)
    hashed = _hashed_windows(cut.filter(F.col("regions") > largest), length)
    found = durable(alone.unionByName(sorted_).unionByName(hashed))
    spans = places.join(found, ["anchor", "region", "windows"]).select("sha", F.explode(F.arrays_zip("starts", "stops")).alias("s"), "first")
    spans = spans.select("sha", F.struct((F.col("first") + F.col("s.starts")).alias("begin"), (F.col("first") + F.col("s.stops") + length - 1).alias("end")).alias("s"))
    spans = durable(spans.groupBy("sha").agg(F.array_sort(F.collect_list("s")).alias("spans")))  # of one text
    return scan.select("doc_id", "sha", "n_bytes").join(texts.select("sha", "rows", "whole"), "sha"), spans


def _kept_ranges(spans: DataFrame) -> DataFrame:
    """sha, n_removed, n_spans and the ranges between the removed runs (begin, end; NULL end for the end of the text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sha, marks in zip(batch["sha"], batch["spans"], strict=True):
                merged: list[list[int]] = []
                for s in marks:
                    if merged and s["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["begin"], s["end"]])
                edges = [0, *[x for m in merged for x in m], None]
                out.append((sha, sum(b - a for a, b in merged), len(merged), [{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            yield pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "ranges"])

    return spans.mapInPandas(run, "sha string, n_removed long, n_spans long, ranges array<struct<begin:long,end:long>>")


def removed(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, largest: int = LARGEST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes, of unchanged texts all).

    Texts travel once, to the few numbers that say what stays of them. Rows of
    equal id and text agree.
    """
    rows, spans = repeats(docs, length, width, largest)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    changed = rows.join(_kept_ranges(spans), "sha", "left").filter("whole or ranges is not null")
    # texts of several rows go as a whole; by (text, id), so copies do not meet in one task
    changed = changed.select("sha", key, "whole", "n_removed", "n_spans", F.when(~F.col("whole"), F.col("ranges")).alias("ranges")).dropDuplicates(["sha", "doc"])
    source = docs.select("doc_id", key, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).withColumn("sha", F.sha2("body", 256))
    both = source.join(changed, ["sha", "doc"], "left")
    size, gone = F.octet_length("body").cast("long"), F.coalesce("whole", F.lit(False))
    # in hexadecimal digits, for which there is a join of arrays
    part = lambda r: F.hex(F.substring(F.col("body"), (r["begin"] + 1).cast("int"), (F.coalesce(r["end"], size) - r["begin"]).cast("int")))
    kept = F.when(gone, F.lit("").cast("binary")).when(F.col("ranges").isNull(), F.col("body")).otherwise(F.unhex(F.array_join(F.transform("ranges", part), "")))
    count = lambda c, whole: F.when(gone, whole).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return both.select("doc_id", size.alias("n_bytes"), count("n_removed", size).alias("n_removed"), count("n_spans", F.lit(1)).alias("n_spans"), kept.alias("kept"))


@query("op7_suffix_dedup", "documents")
def op7(documents: DataFrame) -> DataFrame:
    """Bytes that repeat over 400 or more, the hash of what stays, and what stays as text (a cut character shows as U+FFFD)."""
    out = removed(documents)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
