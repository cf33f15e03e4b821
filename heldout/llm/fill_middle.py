"""Fill-in-the-middle documents by displacement scatter.

Texts of a batch lie behind one another in one byte array. Token ends give the
cuts; a difference array over the bytes gets what changes at each cut, so its
running sum is the displacement of every byte, and one scatter writes all
outputs. The way back reads the marks, builds the opposite displacements and
gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .pieces import byte_rows, cut, string_rows
from .registry import query

#: Marks of prefix, suffix and middle; bytes of text displaced at once; forms by number.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PIECE = 4 << 20
FORMS = ("plain", "psm", "spm")
#: Percent of texts that are transformed, percent of these in the order suffix, prefix, middle; seed of the draws.
RATE, SPM_RATE, SEED = 50, 80, "42"


def _within(hits: np.ndarray, width: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits that end in the row they begin in, their rows)."""
    rows = np.searchsorted(bounds, hits, side="right") - 1
    inside = hits + width <= bounds[rows + 1]
    return hits[inside], rows[inside]


def marks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, and the row of each."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = np.isin(data[1:-1], np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], np.uint8))
    return _within(np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & letter), 3, bounds)


def token_cuts(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, byte place of the smaller cut, of the larger) of each row, the cuts being ``first`` and ``second`` modulo tokens + 1.

    A token is a run of blanks with the word after it; blanks at the end are one more.
    """
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ends = np.zeros(len(data), bool)
    ends[:-1] = blank[1:] & ~blank[:-1]
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
    places = np.r_[0, np.flatnonzero(ends) + 1]
    begin = np.searchsorted(places[1:], bounds[:-1], side="right")
    n = np.searchsorted(places[1:], bounds[1:], side="right") - begin
    a, b = first % (n + 1), second % (n + 1)
    return n, places[begin + np.minimum(a, b)], places[begin + np.maximum(a, b)]


def _displacements(size: int, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Running sum of the difference array that has each (places, change) added."""
    change = np.zeros(size + 1, np.int64)
    for places, by in steps:
        np.add.at(change, places, by)
    return np.cumsum(change[:-1])


def _lay_out(form: np.ndarray, begin: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where prefix, middle and suffix begin in an output that begins at ``begin``."""
    psm, spm = form == 1, form == 2
    at_prefix = begin + 3 * psm + (6 + suffix) * spm
    at_suffix = np.where(spm, begin + 3, begin + prefix + np.where(psm, 6, middle))
    at_middle = begin + prefix + (9 + suffix) * (psm | spm)
    return at_prefix, at_middle, at_suffix


def scattered(data: np.ndarray, bounds: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all rows as bytes and bounds; ``form`` numbers the forms, cuts are byte places."""
    begin, end = bounds[:-1], bounds[1:]
    prefix, middle, suffix = low - begin, high - low, end - high
    out_bounds = np.r_[0, np.cumsum(end - begin + 9 * (form > 0))]
    to_prefix, to_middle, to_suffix = _lay_out(form, out_bounds[:-1], prefix, middle, suffix)
    by_prefix, by_middle, by_suffix = to_prefix - begin, to_middle - low, to_suffix - high
    shift = _displacements(len(data), [(begin, by_prefix), (low, by_middle - by_prefix), (high, by_suffix - by_middle), (end, -by_suffix)])
    out = np.empty(out_bounds[-1], np.uint8)
    shift += np.arange(len(data))
    out[shift] = data
    changed = form > 0
    for mark, at in ((PREFIX, to_prefix), (MIDDLE, to_middle), (SUFFIX, to_suffix)):
        out[(at[changed] - 3)[:, None] + np.arange(3)] = np.frombuffer(mark, np.uint8)
    return out, out_bounds


def gathered(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind outputs: each one's marks say where its parts lie."""
    hits, rows = marks(data, bounds)
    keep = form[rows] > 0
    hits, rows = hits[keep], rows[keep]
    changed = np.flatnonzero(form > 0)
    if not np.array_equal(rows, np.repeat(changed, 3)):
        raise ValueError("an output needs its three marks once each")
    at = hits.reshape(-1, 3)
    begin, end = bounds[:-1].copy(), bounds[1:].copy()
    psm = form[changed] == 1
    letters = np.where(psm[:, None], np.frombuffer(b"PSM", np.uint8), np.frombuffer(b"SPM", np.uint8))
    if not np.array_equal(data[at + 1], letters) or not np.array_equal(at[:, 0], begin[changed]):
        raise ValueError("marks of an output are in the order of its form")
    one, two = at[:, 1] - at[:, 0] - 3, at[:, 2] - at[:, 1] - 3
    prefix, suffix, middle = end - begin, np.zeros_like(begin), np.zeros_like(begin)
    prefix[changed], suffix[changed] = np.where(psm, one, two), np.where(psm, two, one)
    middle[changed] = end[changed] - at[:, 2] - 3
    at_prefix, at_middle, at_suffix = _lay_out(form, begin, prefix, middle, suffix)
    text_bounds = np.r_[0, np.cumsum(prefix + middle + suffix)]
    start = text_bounds[:-1]
    by_prefix, by_middle, by_suffix = at_prefix - start, at_middle - start - prefix, at_suffix - start - prefix - middle
    back = _displacements(text_bounds[-1], [(start, by_prefix), (start + prefix, by_middle - by_prefix), (start + prefix + middle, by_suffix - by_middle), (text_bounds[1:], -by_suffix)])
    back += np.arange(len(back))
    return data[back], text_bounds


def _draw(key: Column, place: int) -> Column:
    """The group ``place`` (from 0) of eight hex digits of the key's hash as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1 + 8 * place, 8), 16, 10).cast("long")


ADDED = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """Documents with ``n`` tokens, ``form``, lengths of prefix and middle in characters (NULL if plain) and ``output``.

    Cuts and form follow from hashes of ``seed`` and doc_id, so reruns agree.
    NULL text is the empty text; that, and a text that holds a mark, stays
    plain; a NULL doc_id draws like an empty one; repeated rows get equal
    outputs; an empty table gives no rows. Columns named like an added one are
    replaced, all others stay. Memory is some thirty bytes for each byte of a
    piece of ``PIECE`` bytes, or of one longer text.
    """
    new = [f.name for f in ADDED]
    kept = [f for f in docs.schema.fields if f.name not in new]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *[_draw(key, k).alias(f"h{k + 1}") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", PIECE):
                data, bounds = byte_rows(part.column(1))
                h1, h2, h3, h4 = (part.column(k).to_numpy() for k in range(2, 6))
                n, low, high = token_cuts(data, bounds, h1, h2)
                form = np.where(h4 % 100 < spm_rate, 2, 1)
                form[(bounds[1:] == bounds[:-1]) | (h3 % 100 >= rate)] = 0
                form[marks(data, bounds)[1]] = 0
                low, high = np.where(form > 0, low, bounds[1:]), np.where(form > 0, high, bounds[1:])
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                prefix, middle = (pa.array(c, mask=form == 0) for c in (chars[low] - chars[bounds[:-1]], chars[high] - chars[low]))
                output = string_rows(*scattered(data, bounds, form, low, high)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()), prefix, middle, output], names=["row", *new])

    out = rows.mapInArrow(run, StructType([StructField("row", StructType(kept)), *ADDED]))
    return out.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept], *new)


def restore(df: DataFrame, out: str = "restored") -> DataFrame:
    """``df`` with the text rebuilt from its columns ``output`` and ``form`` alone, as column ``out`` (replaced if it is there).

    Raises where an output can't be one of its form: marks missing, repeated or in another order, or an unknown form.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    rows = df.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"), "output", "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: k for k, name in enumerate(FORMS)}
        for batch in batches:
            for part in cut(batch, "output", PIECE):
                data, bounds = byte_rows(part.column(1))
                form = np.array([number[f] for f in part.column(2).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), string_rows(*gathered(data, bounds, form)).cast(pa.string())], names=["row", out])

    back = rows.mapInArrow(run, StructType([StructField("row", StructType(kept)), StructField(out, StringType())]))
    return back.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept], out)


SQL = r"""with tokens as (
   select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') t, sha256('42:' || coalesce(doc_id::varchar, '')) h from documents),
 draws as (select *, len(t)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from tokens),
 forms as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
   case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from draws),
 parts as (select *, array_to_string(t[1:a], '') p, array_to_string(t[a + 1:b], '') m, array_to_string(t[b + 1:], '') s from forms)
 select doc_id, n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars, case when form <> 'plain' then length(m) end::bigint middle_chars,
   sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(text) restored_sha256
 from parts"""


@query("op11_fill_middle", "documents", sql=SQL)
def op11(documents: DataFrame) -> DataFrame:
    """Form, part lengths and digests of every document's output and of the text rebuilt from it."""
    out = restore(transform(documents.select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
