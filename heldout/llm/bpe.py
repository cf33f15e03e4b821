"""Byte-pair encoding with word ends: merges by rank from a priority queue over a linked symbol list."""

from __future__ import annotations

import array
import functools
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .registry import query

#: Encoded chunks and words that a task keeps; a store is emptied when it is full. Rows a task holds encoded at once.
KEPT, KEPT_LENGTH, ROWS = 400_000, 64, 500
BLANK = r"\t\n\v\f\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next code point from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(others)) for b in range(256)]


@functools.cache
def late_code_points() -> str:
    """Character ranges that ``regex`` calls letters or digits and the interpreter's older Unicode tables leave unassigned."""
    word = regex.compile(r"[\p{L}\p{N}]")
    late = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and word.match(chr(c))]
    starts = [c for c, before in zip(late, [-1, *late], strict=False) if c != before + 1]
    ends = [c for c, then in zip(late, [*late[1:], -1], strict=False) if c != then - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


class Encoder:
    """Encodes by the tables of a tokenizer file; ``late`` are characters that count as neither letter nor digit."""

    def __init__(self, content: str, late: str = ""):
        tables = json.loads(content)
        self.ids = tables["model"]["vocab"]
        self.end = tables["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in tables["added_tokens"]}
        self.text_of = {i: s for s, i in (*self.ids.items(), *self.special.items())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in tables["model"]["merges"]]
        self.pair = [self.ids[a] << 20 | self.ids[b] for a, b in merges]
        self.new = [self.ids[a + b] for a, b in merges]
        self.rank = {pair: rank for rank, pair in enumerate(self.pair)}
        alphabet = byte_alphabet()
        self.inner = [self.ids[c] for c in alphabet]
        self.last = [self.ids[c + self.end] for c in alphabet]
        split = next(p for p in tables["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"^\s\p{L}\p{N}", rf"^{BLANK}\p{{L}}\p{{N}}")
        if late:
            pattern = pattern.replace(rf"[^{BLANK}\p{{L}}\p{{N}}]", rf"(?:[{late}]|[^{BLANK}\p{{L}}\p{{N}}])").replace(r"[\p{L}]+", rf"(?:(?![{late}])\p{{L}})+").replace(r"|[\p{N}]", rf"|(?![{late}])\p{{N}}")
        self.piece = regex.compile(pattern)
        self.chunk = re.compile(f"[^{BLANK}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def word(self, data: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost on ties. Heap entries are rank and place in one number."""
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        n, rank, pair, push = len(symbol), self.rank.get, self.pair, heapq.heappush
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return symbol
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbol[i] < 0 or symbol[i] << 20 | symbol[j] != pair[r]:
                continue  # stale: one side has been merged meanwhile
            symbol[i], symbol[j] = self.new[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(symbol[i] << 20 | symbol[k])) is not None:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbol[h] << 20 | symbol[i])) is not None:
                push(heap, r << 32 | h)
        return [s for s in symbol if s >= 0]

    def piece_codes(self, piece: str) -> tuple[bytes, str]:
        found = self.words.get(piece)
        if found is None:
            ids = self.word(piece.encode())
            found = array.array("I", ids).tobytes(), " ".join([self.text_of[i] for i in ids])
            if len(piece) <= KEPT_LENGTH:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[piece] = found
        return found

    def chunk_codes(self, chunk: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a chunk without white space."""
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # str.lower looks around a capital sigma
        plain = plain.lower()
        letters = plain.rstrip(".,;:!?")
        if letters.isalpha():  # the usual case: a word, then marks
            pieces = [letters, plain[len(letters) :]] if len(letters) < len(plain) else [letters]
        else:
            pieces = self.piece.findall(plain)
        got = [self.piece_codes(p) for p in pieces]
        found = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        if len(chunk) <= KEPT_LENGTH:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """All ids of a text as little-endian unsigned 32-bit integers, and the vocabulary strings joined by blanks."""
        ids, words = [], []
        for k, part in enumerate(self.cut.split(text or "")):
            if k % 2:
                got = [(struct.pack("<I", self.special[part]), part)]
            else:
                known, make = self.chunks.get, self.chunk_codes
                got = [known(c) or make(c) for c in self.chunk.findall(part)]
            ids += [g[0] for g in got]
            words += [g[1] for g in got if g[0]]
        return b"".join(ids), " ".join(words)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add packed ids and the decoded text of column ``text`` by the tokenizer file at ``path`` (read on the driver).

    NULL and empty texts give no ids and an empty text. Columns named ``ids`` or
    ``decoded`` are replaced, all others stay. Each row is encoded by itself, so
    repeated rows and row order do not matter; memory is bounded by one batch
    and the chunk store.
    """
    with open(path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # size fixed by the vocabulary

    late = late_code_points()

    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    names = [f.name for f in kept] + [ids, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content.value, late)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                done = [encoder.encode(t.as_py()) for t in part.column(part.schema.get_field_index(text))]
                new = [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in kept] + new, names=names)

    return df.mapInArrow(run, StructType([*kept, StructField(ids, BinaryType()), StructField(decoded, StringType())]))


def vocabulary_file() -> str:
    """Default parameter: the installed word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_bpe", "documents")
def op2(documents: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded text of every whole document."""
    out = encode(documents.select("doc_id", "text"), vocabulary_file())
    return out.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
