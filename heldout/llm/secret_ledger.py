"""Secret scanning with an incremental ledger of content-addressed texts.

Every version of a text is named by its hash. Only pairs of (text, rule
version) that the ledger lacks are scanned, once, whatever number of rows holds
the text; findings are then joined back to all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import durable, small

from .registry import query


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count when group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The three base patterns.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What the ledger adds: formats that name themselves, so that clean prose cannot match.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: A text without this has no match of the pattern that is long enough; spares most texts the exact pass.
CUES = {"hex": r"[0-9a-f]{32}", "access": r"AKIA[A-Z0-9]{12}", "assign": r"(?i:password|passwd|secret|token|api_?key)"}
LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def find(text: Column, rule: Rule) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches come from splitting at the pattern, so running
    lengths of piece and match give every place.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("hit"), F.regexp_extract_all(text, pattern, rule.group).alias("part"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(done, x):
        start = done["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(done["out"], F.when(F.char_length(x["part"]) >= rule.least, span).otherwise(none)).alias("out"))

    walked = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(CUES.get(rule.kind, rule.pattern)), walked).otherwise(none)


def content_address(docs: DataFrame) -> DataFrame:
    """doc_id and the hash of its text; NULL counts as the empty text."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))


def scan_unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows: one per (blob, rule version) that ``ledger`` lacks, empty spans included.

    ``paths`` is the written result of ``content_address(docs)``. Copies never
    travel: only the row with the smallest id of a blob meets its text.
    """
    todo = paths.groupBy("blob").agg(F.min("doc_id").alias("_doc"))
    todo = todo.select("blob", F.coalesce(F.col("_doc").cast("string"), F.lit("")).alias("_doc"), F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("_r")).select("blob", "_doc", "_r.*")
    if ledger is not None:
        todo = todo.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    todo = todo.groupBy("blob", "_doc").agg(F.collect_set("kind").alias("_kinds"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    texts = texts.withColumn("blob", F.sha2("_text", 256)).join(todo, ["blob", "_doc"])
    results = [F.when(F.array_contains("_kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find(F.col("_text"), r).alias("spans"))) for r in rules]
    scanned = texts.select("blob", F.explode(F.array_compact(F.array(*results))).alias("_f")).select("blob", "_f.*")
    return scanned.dropDuplicates(["blob", "kind", "version"])


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then by the order of the rules, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Every row of ``paths`` with all spans of its blob under the given rule versions."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    hits = ledger.filter((F.col("version") == current[F.col("kind")]) & (F.size("spans") > 0))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
    per_blob = hits.select("blob", spans.alias("_s")).groupBy("blob").agg(F.flatten(F.collect_list("_s")).alias("spans"))
    table = paths.join(small(per_blob), "blob", "left")
    return table.withColumn("spans", F.coalesce("spans", F.array().cast(per_blob.schema["spans"].dataType)))


SQL_KIND = """ {kind}_p as (select blob, regexp_extract_all(text, '{p}', 0) m, regexp_extract_all(text, '{p}', {g}) g, list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) w from blobs where regexp_matches(text, '{cue}')),
 {kind}_s as (select blob, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(w[1:i]) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'l': length(m[i]), 'g': length(g[i])}})) u from {kind}_p),
 {kind}_f as (select blob, u.s::bigint s, (u.s + u.l)::bigint e, {order} k, '{kind}' kind from {kind}_s where u.g >= {least}),"""
SQL = (
    "with blobs as (select distinct sha256(coalesce(text, '')) blob, coalesce(text, '') as text from documents),"
    + "".join(SQL_KIND.format(kind=r.kind, p=r.pattern.replace("'", "''"), g=r.group, cue=CUES.get(r.kind, r.pattern), least=r.least, order=k) for k, r in enumerate(RULES))
    + " hits as (" + " union all ".join(f"select * from {r.kind}_f" for r in RULES) + """),
 per_blob as (select blob, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') c, count(*) filter (kind = 'hex') h,
   coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3), '') base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) spans from hits group by blob)
 select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(c, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
 from documents left join per_blob on blob = sha256(coalesce(text, ''))"""
)


@query("op10_secrets", "documents", sql=SQL)
def op10(documents: DataFrame) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    paths = durable(content_address(documents))
    ledger = durable(scan_unseen(documents, paths))
    out = findings_by_path(paths, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return out.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
