"""Scans of text tables, sidecars and file manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import durable
from ..operators.ranking import positions

#: Names of files that the line reader unpacks, and the bytes it leaves out at a file's start.
PACKED, BOM = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zstd?|passthrough)$", b"\xef\xbb\xbf"


def _below(root: str, path: Column) -> Column:
    """The part of a file's path below ``root``; files of one name in two folders stay apart."""
    clean = root.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    tail = F.element_at(F.split(path, F.lit("/" + re.escape(clean) + "/"), 2), -1)
    return F.when(F.contains(path, F.lit("/" + clean + "/")), tail).otherwise(F.element_at(F.split(path, "/"), -1))


def read_numbered_rows(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Rows of headerless delimited files with the file's path below ``path`` and line number; all columns stay strings.

    Blank lines count in the numbering and are then left out. Lines are ordered
    by their file split and place in it, so a large file is read in parallel.
    """
    lines = spark.read.text(path).select(
        _below(path, F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    numbered = positions(lines, ["file"], ["_start", "_at"], "_p").filter(F.trim("value") != "")
    schema = ", ".join(f"`{c}` string" for c in columns)
    row = F.from_csv("value", schema, {"sep": sep, "mode": "FAILFAST"})
    return numbered.select("file", (F.col("_p") + 1).alias("row_number"), row.alias("_r")).select("file", "row_number", "_r.*")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t", pattern: str = "*.tsv") -> DataFrame:
    """Delimited files with a header below a folder, with an explicit schema."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True, pathGlobFilter=pattern, recursiveFileLookup=True, multiLine=False)


def path_entities(df: DataFrame, path: str, pattern: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose whole path matches with the captured parts as columns, rejected paths)."""
    full = f"^(?:{pattern})$"
    hit = F.coalesce(F.col(path).rlike(full), F.lit(False))
    good = df.filter(hit).select("*", *[F.regexp_extract(path, full, i + 1).alias(n) for i, n in enumerate(names)])
    return good, df.filter(~hit).select(path, F.lit("PATH_NOT_RECOGNISED").alias("reason"))


def signature_counts(df: DataFrame, *signature: Column) -> DataFrame:
    """Rows per distinct metadata signature."""
    return df.groupBy(*signature).agg(F.count(F.lit(1)).alias("n"))


def _run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, sha256) of lines that follow one another in a file; no hash where they do not make the file's size.

    Each ``line`` ends with a line feed, which the file's last one may lack, and
    a byte order mark at a file's start is missing; its size tells both.
    """
    at = size = None

    def done():
        out = [h for h, more in ((plain, 0), (marked, 3)) if total + more in (size, size + 1)]
        if out and total + (3 if out[0] is marked else 0) == size:
            out[0].update(b"\n")
        return pa.RecordBatch.from_pydict({"run": pa.array([at], pa.int64()), "sha256": pa.array([out[0].hexdigest() if out else None], pa.string())})

    for batch in batches:
        if not batch.num_rows:
            continue
        runs, sizes, lines = batch.column(0).to_numpy(), batch.column(1), batch.column(2).cast(pa.large_binary())
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        content = memoryview(lines.buffers()[2])
        cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1), len(runs)]
        for first, last in zip(cuts[:-1], cuts[1:]):
            if runs[first] != at:
                if at is not None:
                    yield done()
                at, size, total = int(runs[first]), sizes[int(first)].as_py(), 0
                plain, marked = hashlib.sha256(), hashlib.sha256(BOM)
            piece = content[ends[first] : ends[last]]
            for h in (plain, marked):
                if total:
                    h.update(b"\n")
                h.update(piece[:-1])
            total += len(piece)
    if at is not None:
        yield done()


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path below the folder (``name``), size and SHA-256 of every file there.

    A hash is one chain, so one task reads a file, but line by line: no file is
    a value, and only a line has to stay below 2 GB. Files with names that the line
    reader would unpack are read as one value each, as are those that did not come out whole.
    """
    under = lambda kind, **more: spark.read.format(kind).options(pathGlobFilter=pattern, recursiveFileLookup="true", **more).load(path)
    at = F.col("_metadata.file_path")
    values = under("binaryFile")
    files = durable(values.select(at.alias("_at"), _below(path, F.col("path")).alias("name"), F.col("length").alias("bytes")))
    run = lambda file, start: F.xxhash64(file, start.cast("long"))
    lines = under("text", lineSep="\n").filter(~at.rlike(PACKED)).select(
        run(at, F.col("_metadata.file_block_start")).alias("run"), F.col("_metadata.file_size").cast("long").alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    # no file is cut, and small ones share a task
    whole = {"spark.sql.files.maxPartitionBytes": f"{files.agg(F.max('bytes')).first()[0] or 1}b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in whole}
    try:
        for k, v in whole.items():
            spark.conf.set(k, v)
        hashed = durable(lines.mapInArrow(_run_hashes, "run long, sha256 string"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hashed = hashed.filter("sha256 is not null")
    known = files.join(hashed, run(F.col("_at"), F.lit(0)) == F.col("run"), "left").select("_at", "name", "bytes", "sha256")
    rest = [r[0] for r in known.filter("sha256 is null").select("_at").collect()]
    if not rest:
        return known.drop("_at")
    # a filter on the path leaves out files before they are read
    others = values.filter(at.isin(rest)).select(at.alias("_at"), F.sha2("content", 256).alias("_other"))
    return known.join(durable(others), "_at", "left").select("name", "bytes", F.coalesce("sha256", "_other").alias("sha256"))


def table_manifest(files: DataFrame, suffix: str) -> DataFrame:
    """Manifest of tables from that of their files: a table is a file, or a folder of part files, whose name ends with ``suffix``.

    A table of one file keeps that file's hash; a folder has the bytes of all its parts and the hash of their names, sizes and hashes in order.
    """
    table = F.regexp_extract("name", "^(.*?" + re.escape(suffix) + ")(?:/|$)", 1)
    part = F.substring(F.col("name"), F.length("_t") + 2, F.length("name"))
    rows = files.select(F.when(table == "", F.col("name")).otherwise(table).alias("_t"), "name", "bytes", "sha256").select("*", part.alias("_p"))
    one = F.struct("_p", "bytes", "sha256")
    packed = rows.groupBy("_t").agg(F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(one)).alias("_f"))  # one small entry a file
    lines = F.transform("_f", lambda f: F.concat_ws("|", f["_p"], f["bytes"].cast("string"), f["sha256"]))
    alone = (F.size("_f") == 1) & (F.col("_f")[0]["_p"] == "")
    return packed.select(F.col("_t").alias("name"), "bytes", F.when(alone, F.col("_f")[0]["sha256"]).otherwise(F.sha2(F.array_join(lines, "\n"), 256)).alias("sha256"))


def reconcile(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Status of each file: missing, wrong size, wrong hash or verified, or not in the manifest."""
    o = listing.select("name", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    status = F.when(F.col("_s").isNull(), "MISSING").when(F.col("_b") != F.col("bytes"), "SIZE_MISMATCH").when(F.col("_s") != F.col("sha256"), "HASH_MISMATCH").otherwise("VERIFIED")
    known = F.col("bytes").isNotNull() | F.col("sha256").isNotNull()
    return manifest.join(o, "name", "full").select("name", F.when(known, status).otherwise("NOT_IN_MANIFEST").alias("status"))


def forbidden_fields(schema: T.StructType, parts: list[str], path: str = "") -> list[str]:
    """Dotted names of fields at any depth whose name holds a forbidden part."""
    found = []

    def walk(kind, at):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = f"{at}.{f.name}" if at else f.name
                if any(p in f.name.casefold() for p in parts):
                    found.append(here)
                walk(f.dataType, here)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at + "[]")
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, at + "{}")

    walk(schema, path)
    return found


def forbidden_payload_keys(df: DataFrame, payload: str, parts: list[str]) -> DataFrame:
    """Rows per payload key, at any depth, that holds a forbidden part; the payload is JSON.

    In JSON only a key is a string with a colon after it.
    """
    keys = F.regexp_extract_all(payload, F.lit(r'"((?:[^"\\\\]|\\\\.)*)"\s*:'), 1)
    k = df.select(F.explode(F.array_distinct(keys)).alias("payload_key")).groupBy("payload_key").agg(F.count(F.lit(1)).alias("n"))
    held = F.lit(False)
    for part in parts:
        held = held | F.contains(F.lower("payload_key"), F.lit(part.lower()))
    return k.filter(held)


def require_fields(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError("missing required fields: " + ", ".join(missing))


def missing_fields(df: DataFrame, fields: dict) -> DataFrame:
    """Rows that lack a required field, with the names they lack in order; NULL and blank strings count as lacking."""
    lacks = [F.when(c.isNull() | (F.trim(c.cast("string")) == ""), name) for name, c in sorted(fields.items())]
    return df.withColumn("missing", F.array_compact(F.array(*lacks))).filter(F.size("missing") > 0)
