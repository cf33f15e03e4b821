"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by (page_id, url, payload hash, copy) and cut into shards
where a weighted sample by hash says. Each shard is one sorted stream that rolls
to a new file at a compressed size. Files are written under temporary names; the
manifest table lists those of the attempts that Spark counted, and only they get
their final names. Readers take files from a committed manifest only.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heldout.operators.durable import checkpoint_root, durable, small

from .registry import query

#: Bytes of records that a shard aims at, shards at most, samples drawn per shard; compressed bytes at which a file is closed; payload bytes from which equal payloads are revisited.
SHARD, SHARDS, SAMPLES, ROLL, SMALLEST = 64 << 20, 16_384, 64, 1 << 30, 0
#: Bytes that a record has beside its payload, about; the date that every record bears; gzip level; bytes read at once; payload bytes of a batch given to Spark.
HEADER, DATE, LEVEL, READ, BATCH = 700, "2024-01-01T00:00:00Z", 6, 1 << 20, 8 << 20
KEY = ("page_id", "url", "sha", "copy")


def digest32(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    """A URL fit for a header line: blanks, controls and what is not ASCII percent-coded; the empty string for NULL."""
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")


def _name(page_id: int | None, payload: str, copy: int) -> str:
    """The id of a record; NULL has an empty place."""
    return f"<urn:page:{'' if page_id is None else page_id}:{payload}:{copy}>"


def page_record(page_id, url, payload: bytes | None, n_bytes: int, payload_digest: str, copy: int, refers: tuple | None) -> bytes:
    """A response with its payload, or a revisit (``payload`` None) of the record (page_id, url) that ``refers`` names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _name(page_id, payload_digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is not None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers[0], payload_digest, 1)), ("WARC-Refers-To-Target-URI", _uri(refers[1]))]
    return _record("revisit", fields, http)


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared store that a folder's URI or path names, the same from driver and executors."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")


MANIFEST = "shard int, number int, name string, temporary string, records long, compressed long, sha1 string"


class _Roller:
    """Files of one shard: one gzip member per record, closed once they have ``roll`` compressed bytes."""

    def __init__(self, fs, folder: str, shard: int, attempt: str, roll: int):
        self.fs, self.folder, self.shard, self.attempt, self.roll = fs, folder, shard, attempt, roll
        self.number, self.out, self.done = 0, None, []

    def _put(self, record: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without a time stamp
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.sum.update(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.out, self.sum, self.size, self.records = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), hashlib.sha1(), 0, 0
            self._put(_record("warcinfo", [("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.number, self.name, self.temporary, self.records, self.size, self.sum.hexdigest()))
            self.number, self.out = self.number + 1, None


def _splitters(records: DataFrame, shard: int, shards: int) -> list[tuple]:
    """Sort keys at which shards begin, from a sample by hash: about ``SAMPLES`` keys a shard, whatever the table's size."""
    total = records.agg(F.count(F.lit(1)), F.sum("weight")).first()
    wanted = min(shards, -(-(total[1] or 0) // shard))
    if wanted < 2:
        return []
    rate = min(1.0, SAMPLES * wanted / total[0])
    drawn = F.pmod(F.xxhash64(F.lit(11), *KEY), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    sample = sorted((_order(*r[:4]), r[4]) for r in records.filter(drawn).select(*KEY, "weight").collect())
    cuts, seen, step = [], 0, sum(w for _, w in sample) / wanted
    for key, weight in sample:
        seen += weight
        if seen >= step * (len(cuts) + 1) and len(cuts) + 1 < wanted:
            cuts.append(key)
    return sorted(set(cuts))


def _order(page_id, url, sha, copy) -> tuple:
    """The sort key: ids by number with NULL last, then url with NULL first."""
    return page_id is None, page_id or 0, url is not None, (url or "").encode(), bytes(sha), copy


def planned(pages: DataFrame, smallest: int = SMALLEST) -> tuple[DataFrame, DataFrame]:
    """(records without payload: key, n_bytes, refers, weight; leaders of payloads that several rows hold).

    ``refers`` is NULL for a response. Rows alike in id, url and payload are
    counted first; all but one of a payload's rows are revisits, which need no
    payload, so a hot page costs short records only.
    """
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)).alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("sha1"))
    groups = durable(hashed.groupBy("page_id", "url", "sha", "n_bytes", "sha1").agg(F.count(F.lit(1)).alias("rows")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    leaders = groups.filter(F.col("n_bytes") >= smallest).groupBy("sha").agg(first, F.sum("rows").alias("all")).filter("all > 1")
    leaders = small(leaders.select("sha", F.col("first.page_id").alias("l_id"), F.col("first.url").alias("l_url")))
    both = groups.join(leaders.withColumn("led", F.lit(True)), "sha", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("l_id")) & F.col("url").eqNullSafe(F.col("l_url"))
    each = both.select("page_id", "url", "sha", "n_bytes", "sha1", "l_id", "l_url", F.coalesce("led", F.lit(False)).alias("led"), is_first.alias("is_first"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    refers = F.when(F.col("led") & ~(F.col("is_first") & (F.col("copy") == 1)), F.struct(F.col("l_id").alias("id"), F.col("l_url").alias("url")))
    records = each.select(*KEY, "n_bytes", "sha1", refers.alias("refers"))
    return durable(records.withColumn("weight", F.lit(HEADER) + F.when(F.col("refers").isNull(), F.col("n_bytes")).otherwise(0))), leaders


def write(pages: DataFrame, folder: str, smallest: int = SMALLEST, shard: int = SHARD, shards: int = SHARDS, roll: int = ROLL) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``; returns the committed manifest.

    Of equal payloads of ``smallest`` bytes or more the row with the smallest
    page_id (NULL last; then url, NULL first) is the response, the others revisit it. NULL html is the
    empty payload, a NULL url an empty one; repeated rows are records of their
    own; an empty table commits an empty manifest; further columns are not
    read. The same rows give the same files, byte for byte, on any cluster.
    A page is held as a whole, a shard never. ``folder`` is a path or URI of
    a store that all executors share. Splitters are bounded by ``shards``.
    """
    records, leaders = planned(pages, smallest)
    cuts = _splitters(records, shard, shards)

    @F.pandas_udf("int")
    def number(page_id: pd.Series, url: pd.Series, sha: pd.Series, copy: pd.Series) -> pd.Series:
        keys = zip(page_id.array, url, sha, copy, strict=True)
        return pd.Series([bisect.bisect_right(cuts, _order(None if i is None or i != i else int(i), u, s, c)) for i, u, s, c in keys], dtype="int32")

    # a long keeps all its digits only without NULL, so the id travels as text
    placed = lambda df: df.withColumn("shard", number(F.col("page_id").cast("string"), "url", "sha", "copy"))
    bodies = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha2("html", 256)))
    bodies = bodies.join(leaders.withColumn("led", F.lit(True)), "sha", "left").withColumn("led", F.coalesce("led", F.lit(False)))
    mine = F.col("page_id").eqNullSafe(F.col("l_id")) & F.col("url").eqNullSafe(F.col("l_url"))
    no_reference = F.lit(None).cast("struct<id:bigint,url:string>").alias("refers")
    # alone below the threshold: repeated short payloads are responses each, numbered as planned
    several = records.filter("refers is null and copy > 1").select("page_id", "url", "sha", "copy")
    unique = bodies.filter(~F.col("led")).select("page_id", "url", "sha", "html", no_reference, F.lit(1).cast("long").alias("copy"))
    if smallest > 0:
        unique = unique.dropDuplicates(["page_id", "url", "sha"])
        more = several.join(unique.filter(F.octet_length("html") < smallest).select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("sha").alias("s"), "html"), F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("sha") == F.col("s")))
        unique = unique.unionByName(more.select("page_id", "url", "sha", "html", no_reference, "copy"))
    first = bodies.filter(F.col("led") & mine).select("page_id", "url", "sha", "html").dropDuplicates(["sha"]).select("*", no_reference, F.lit(1).cast("long").alias("copy"))
    revisits = records.filter("refers is not null").select(*KEY, F.lit(None).cast("string").alias("html"), "refers", "n_bytes", "sha1")
    responses = unique.unionByName(first).select("*", F.octet_length("html").cast("long").alias("n_bytes"), F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha1"))
    rows = placed(responses.unionByName(revisits))
    partitions = max(1, min(len(cuts) + 1, 100_000))
    rows = rows.select("shard", F.col("page_id").isNull().alias("none"), *KEY, "html", "refers", "n_bytes", "sha1").repartitionById(partitions, F.col("shard")).sortWithinPartitions("shard", "none", *KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(f"{top}/_temporary", recursive=True)
        attempt, roller, done = uuid.uuid4().hex, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    if roller is None or roller.shard != r["shard"]:
                        if roller is not None:
                            roller.close()
                            done += roller.done
                        roller = _Roller(fs, top, r["shard"], attempt, roll)
                    payload = None if r["html"] is None else r["html"].encode("utf-8", "surrogatepass")
                    refers = None if r["refers"] is None else (r["refers"]["id"], r["refers"]["url"])
                    roller.add(page_record(r["page_id"], r["url"], payload, r["n_bytes"], base64.b32encode(r["sha1"]).decode(), r["copy"], refers))
        if roller is not None:
            roller.close()
            done += roller.done
        names = [p.split(" ")[0] for p in MANIFEST.split(", ")]
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=names), preserve_index=False).cast(pa.schema([("shard", pa.int32()), ("number", pa.int32()), *[(n, pa.string()) for n in names[2:4]], ("records", pa.int64()), ("compressed", pa.int64()), ("sha1", pa.string())]))

    written = durable(rows.mapInArrow(run, MANIFEST))
    return _commit(written, folder)


def _commit(written: DataFrame, folder: str) -> DataFrame:
    """Give the listed files their final names and write the manifest, the last thing done. A repeated attempt finds its file moved and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{top}/{r['temporary']}").type == pafs.FileType.File:
                    fs.move(f"{top}/{r['temporary']}", f"{top}/{r['name']}")
                info = fs.get_file_info(f"{top}/{r['name']}")
                if info.type != pafs.FileType.File or info.size != r["compressed"]:
                    raise FileNotFoundError(f"{r['name']} is missing or has another size")
            yield batch

    spark = written.sparkSession
    written.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    fs, top = _filesystem(folder)
    left = fs.get_file_info(f"{top}/_temporary")
    if left.type == pafs.FileType.Directory:
        fs.delete_dir(f"{top}/_temporary")  # what attempts that did not count have left
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files of an archive; raises if it was not committed."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


class _Members:
    """Records of a gzip stream with a member each, read piece by piece."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def __iter__(self) -> Iterator[bytes]:
        while self.rest or self._more():
            z, out = zlib.decompressobj(31), io.BytesIO()
            while not z.eof:
                if not self.rest and not self._more():
                    raise EOFError("a record ends early")
                out.write(z.decompress(self.rest))
                self.rest = z.unused_data
            yield out.getvalue()

    def _more(self) -> bool:
        self.rest = self.stream.read(READ)
        return bool(self.rest)


def parsed(record: bytes) -> dict:
    """Header fields in lower case, type, block; raises if lengths or digests do not fit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("not a record of the stated length")
    if fields["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError("a block does not have its digest")
    return {"type": fields["warc-type"], "block": block, **{k: v for k, v in fields.items() if k not in ("type", "block")}}


def _id(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of a committed archive, its ``payload`` (NULL for revisits) included, lengths and digests verified.

    ``url`` is as written in the header: percent-coded where a header line needs it, empty for NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for record in _Members(stream):
                        r = parsed(record)
                        if r["type"] == "warcinfo":
                            continue
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        length = int(http.decode().rpartition("Content-Length: ")[2])
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        whole = r["type"] == "response"
                        if whole and (len(payload) != length or digest32(payload) != digest):
                            raise ValueError("a payload does not have its length and digest")
                        rows.append((_id(r["warc-record-id"]), r["warc-target-uri"], r["type"], length, digest, None if whole else _id(r["warc-refers-to"]), payload if whole else None))
                        size += len(payload) + 200
                        if size >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = manifest(spark, folder).select("name")
    return files.repartitionByRange(max(1, min(files.count(), 100_000)), "name").mapInArrow(run, RECORD)


SQL = """with hashed as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
 first as (select h, min(page_id) k from hashed group by h)
 select page_id, strlen(html)::bigint payload_bytes,
   array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hashed.h, (1 + 5 * i)::integer, 5))::bigint >> s) & 31) + 1, 1)), '')), '') payload_digest,
   case when page_id = k then 'response' else 'revisit' end record_type, case when page_id <> k then k end refers_to
 from hashed join first using (h)"""


@query("op13_warc", "pages", sql=SQL)
def op13(pages: DataFrame) -> DataFrame:
    """Every page's record as read back from the archives just written."""
    folder = f"{checkpoint_root(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(pages.sparkSession, folder).drop("payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
