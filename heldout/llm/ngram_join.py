"""Exact Jaccard join on word shingles by vertical partitioning.

The order of all shingles (by hash) is cut into fragments. A first job counts,
fragment by fragment, in how many sets a shingle lies, and hands the shared
ones back: only sets that share enough can have a partner, and their rarest
shared shingles are the keys under which partners meet. A second one counts the
overlaps of candidate pairs in every fragment separately and sums them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import durable, small

from .linking import link
from .registry import query

WIDTH, PERCENT = 5, 75
#: Shingles in a fragment of the counting job, and in a batch of documents; fragments of the overlap job.
FRAGMENT, BATCH, PIECES = 1_000_000, 1_000_000, 8
KEPT_WORDS = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, {}

    def _hash(self, word: bytes) -> int:
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        value = self.words[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        known, make, n = self.words, self._hash, len(words)
        codes = np.fromiter((known.get(w) or make(w) for w in words), np.uint64, n)
        if n < self.width:
            return codes[:0] if not n else np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8, person=b"whole").digest(), "little")], np.uint64)
        total = np.zeros(n - self.width + 1, np.uint64)
        for j in range(self.width):
            total += codes[j : n - self.width + 1 + j] * np.uint64(2 * 0x2545F4914F6CDD1D * (j + 1) + 1 & (1 << 64) - 1)
        return np.unique(_mix(total))


def set_id(tokens: np.ndarray) -> int:
    """Signed 64-bit name of a set; the empty set is 0."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8, person=b"set").digest(), "little", signed=True) if len(tokens) else 0


def _least(n, percent):
    """Shingles that a set of n must share with a partner."""
    return -(-n * percent // 100)


#: A shingle counts as this common at most; one as common within a batch needs no counting elsewhere.
COMMON, SETTLED = 255, 65535
PARTS = pa.schema([("group", pa.int64()), ("frag", pa.int64()), ("batch", pa.int64()), ("low", pa.binary()), ("at", pa.binary()), ("df", pa.binary()), ("ids", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])
PARTS_SQL = "group long, frag long, batch long, low binary, at binary, df binary, ids array<long>, docs array<long>, place array<int>, sizes array<int>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in PARTS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, PARTS.types, strict=True)], schema=PARTS)


def _cut(docs: DataFrame, bits: int, width: int) -> DataFrame:
    """Per batch of documents: a head row with its sets, and for each of 2**bits fragments its (shingle, set) entries.

    Shingles are cut to ``bits`` + 32 bits here: a chance collision makes one
    look shared, which adds a candidate and loses none. Entries of a shingle
    that ``COMMON`` sets of the batch share go straight to the batch's end; the
    fragment gets one entry in their place, so no fragment grows with a hot one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, count = Shingler(width), itertools.count()

        def flush(docs, place, ids, sets) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int32)
            name = int.from_bytes(hashlib.blake2b(f"{TaskContext.get().partitionId()} {next(count)} {ids}".encode(), digest_size=8).digest(), "little", signed=True)
            aside = -1 - (name & 0x3FFF)
            tokens = np.concatenate(sets) >> np.uint64(32 - bits)
            at = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, at = tokens[order], at[order]
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, int)
            often = np.repeat(np.diff(np.r_[starts, len(tokens)]) >= COMMON, np.diff(np.r_[starts, len(tokens)]))
            first = np.zeros(len(tokens), bool)
            first[starts] = True
            rows = [(aside, -1, name, None, None, None, ids, docs, place, sizes.tolist())]
            for chosen, mark in ((often, True), (~often | first, False)):
                t, a = tokens[chosen], np.where(often[chosen] & (not mark), SETTLED, at[chosen]).astype(np.uint16)
                cuts = np.searchsorted(t, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                low = (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for f in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[f], cuts[f + 1])
                    rows.append((aside if mark else f, f, name, low[part].tobytes(), a[part].tobytes(), bytes([COMMON]) * (cuts[f + 1] - cuts[f]) if mark else None, None, None, None, None))
            return _batch(rows)

        docs, place, ids, sets, seen, held = [], [], [], [], {}, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = shingle(text.as_py())
                name = set_id(tokens)
                if name not in seen:
                    seen[name] = len(ids)
                    ids.append(name)
                    sets.append(tokens)
                    held += len(tokens)
                docs.append(doc)
                place.append(seen[name])
                if held >= BATCH or len(ids) >= 60_000 or len(docs) >= 200_000:
                    yield flush(docs, place, ids, sets)
                    docs, place, ids, sets, seen, held = [], [], [], [], {}, 0
        if docs:
            yield flush(docs, place, ids, sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PARTS_SQL)


def _count(parts: DataFrame) -> DataFrame:
    """In every fragment: the entries whose shingle lies in several sets, with its (capped) count."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        lows = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
        ats = [np.frombuffer(x, np.uint16) for x in table["at"].to_pylist()]
        low, at = np.concatenate(lows), np.concatenate(ats)
        _, back, weight = np.unique(low, return_inverse=True, return_counts=True)
        weight = weight + np.bincount(back, at == SETTLED, len(weight)).astype(np.int64) * (COMMON - 1)
        df = np.minimum(weight, COMMON)[back].astype(np.uint8)
        keep = (df > 1) & (at != SETTLED)
        rows, begin = [], 0
        for f, name, n in zip(table["frag"].to_pylist(), table["batch"].to_pylist(), map(len, lows), strict=True):
            k = keep[begin : begin + n]
            if k.any():
                rows.append((0, f, name, low[begin : begin + n][k].tobytes(), at[begin : begin + n][k].tobytes(), df[begin : begin + n][k].tobytes(), None, None, None, None))
            begin += n
        return pa.Table.from_batches([_batch(rows)])

    return parts.groupBy("group").applyInArrow(run, PARTS_SQL)


def _rarest(counted: DataFrame, percent: int) -> DataFrame:
    """Per document: its set, the set's size and, once a batch, the keys under which the set meets partners.

    In the order by count, then hash, unshared shingles come first. Two sets
    similar enough share one of their first n - least + 1 shingles; what the
    unshared ones leave of these places are the keys.
    """
    out = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frags = table["frag"].to_pylist()
        head = frags.index(-1)
        ids, docs, place, sizes = (table[c][head].as_py() for c in ("ids", "docs", "place", "sizes"))
        tokens, ats, dfs = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)], [np.empty(0, np.uint8)]
        for f, low, at, df in zip(frags, table["low"].to_pylist(), table["at"].to_pylist(), table["df"].to_pylist(), strict=True):
            if f >= 0:
                tokens.append(np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(f << 32))
                ats.append(np.frombuffer(at, np.uint16))
                dfs.append(np.frombuffer(df, np.uint8))
        token, at, df = np.concatenate(tokens), np.concatenate(ats), np.concatenate(dfs)
        order = np.lexsort((token, df, at))
        token, at = token[order].astype(np.int64), at[order]
        n = np.array(sizes, np.int64)
        ends = np.searchsorted(at, np.arange(len(ids)), side="right")
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        room = (ends - starts) - _least(n, percent) + 1
        first: set[int] = set()
        keys = []
        for p in place:
            new = p not in first and n[p] > 0
            first.add(p)
            keys.append(token[starts[p] : starts[p] + room[p]].tolist() if new and room[p] > 0 else None)
        return pa.table([pa.array(docs, pa.int64()), pa.array([ids[p] for p in place], pa.int64()), pa.array([sizes[p] for p in place], pa.int64()), pa.array(keys, out.field("keys").type)], schema=out)

    return counted.groupBy("batch").applyInArrow(run, "doc_id long, set_id long, n_shingles long, keys array<long>")


def _fragments(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets ``wanted`` (set_id, doc): for each of ``PIECES`` ranges of the order their shingles there."""
    shift = np.uint64(64 - PIECES.bit_length() + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            rows = []
            for name, text in zip(batch["set_id"], batch["text"], strict=True):
                tokens = shingle(text)
                if set_id(tokens) == name:
                    cuts = np.searchsorted(tokens, np.arange(1, PIECES, dtype=np.uint64) << shift)
                    rows += [(name, len(tokens), j, t.view(np.int64)) for j, t in enumerate(np.split(tokens, cuts)) if len(t)]
            yield pd.DataFrame(rows, columns=["id", "n", "piece", "tokens"])

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(key.alias("doc"), "text").join(wanted, "doc").select("set_id", "text")
    return texts.mapInPandas(run, "id long, n long, piece int, tokens array<long>").dropDuplicates(["id", "piece"])


def similar(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id, set_id, n_shingles and component_id; links of set ids that were needed to connect them).

    A-Z are lower-cased; a text of fewer than ``width`` words is one shingle; one
    without words, or NULL, is the empty set and linked with nothing. Documents
    with equal sets are one set from the start, however many they are. The
    component is the smallest doc_id that links reach; documents with a NULL id
    take part but give no component id. Repeated rows are documents with equal
    sets; an empty table gives no rows. Sets are told apart by 64-bit hashes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1.0, size / 6 / FRAGMENT)))))
    counted = durable(_count(_cut(docs, min(bits, 31), width)))
    sets = durable(_rarest(counted, percent))
    placed = sets.filter("keys is not null").select(F.posexplode("keys").alias("at", "key"), F.col("set_id").alias("id"), "n_shingles", F.size("keys").alias("_k"))
    # shingles of the set from this one on, in the common order
    left = F.col("_k") - 1 + F.ceil(F.col("n_shingles") * percent / F.lit(100)) - F.col("at")
    members = placed.select("key", "id", F.struct(F.col("n_shingles").alias("n"), left.alias("left")).alias("n"))
    met = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    members = durable(members.join(met, "key"))
    per_set = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    wanted = members.select(F.col("id").alias("set_id")).distinct().join(per_set, "set_id").select("set_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"))
    pieces = durable(_fragments(docs, small(wanted), width))

    def verify(pairs: DataFrame) -> DataFrame:
        left = pieces.select(F.col("id").alias("a"), F.col("n").alias("na"), "piece", F.col("tokens").alias("ta"))
        right = pieces.select(F.col("id").alias("b"), F.col("n").alias("nb"), "piece", F.col("tokens").alias("tb"))
        both = pairs.join(left, "a").join(right, ["b", "piece"])
        parts = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("shared"))
        sums = parts.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("s"))
        return sums.filter(F.lit(100) * F.col("s") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("s"))).select("a", "b")

    def possible(x: Column, y: Column) -> Column:
        # if this is the first shingle that the two share, no more than those from here on can be shared
        return F.lit(100 + percent) * F.least(x["left"], y["left"]) >= F.lit(percent) * (x["n"] + y["n"])

    links, labels = link(members, verify, possible)
    per_set = per_set.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    per_set = durable(per_set.filter("rows > 1 or component is not null").withColumn("component", F.coalesce("component", "set_id")))
    lowest = per_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = per_set.join(lowest, "component").select("set_id", "component_id")
    out = sets.select("doc_id", "set_id", "n_shingles").join(small(found), "set_id", "left")
    return out.select("doc_id", "set_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), links


@query("op5_ngram_join", "documents")
def op5(documents: DataFrame) -> DataFrame:
    """Shingle count and component of every document."""
    return similar(documents)[0].select("doc_id", "n_shingles", "component_id")
