"""Mixing sources to target weights along a curriculum.

Every source has a weight (its share of the mix) and a schedule (how its rate
changes over training time 0..1). The integral of the schedule is the share of
the source's demand served so far; inverting it at a document's place in its
source gives the time at which training reaches the document. Sorting by that
time is the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.operators.durable import durable, small
from heldout.operators.ranking import positions, running_sum

from .numbering import numbered
from .registry import WORD, query, word_count

WEIGHTS = (3, 1, 2)
#: Knots (time, rate) of the schedules that sources take in turn: falling, steady, rising late.
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
SHARE, PASSES = 1.5, 2


def time_at(done: Column, knots) -> Column:
    """Time at which the piecewise linear rate ``knots`` has served the share ``done`` (0..1) of its integral."""
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        parts.append((total, t0, w0, (w1 - w0) / (t1 - t0)))
        total += (w0 + w1) / 2 * (t1 - t0)
    at = None
    for before, t0, w0, slope in reversed(parts):
        left = done * F.lit(total) - F.lit(before)
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * left)
        here = F.lit(t0) + F.lit(2.0) * left / (F.lit(w0) + root)
        at = here if at is None else F.when(done * F.lit(total) < F.lit(parts[parts.index((before, t0, w0, slope)) + 1][0]), here).otherwise(at)
    return at


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Per source: its rank by code point (NULL last), size, target and the index of its turn.

    Shares stop at ``passes`` times the source; the excess goes to the others by
    weight until none is above. Each round is one aggregate with one row.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = positions(sums, [], [F.col("source").asc_nulls_last()], "turn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    table = durable(placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes))
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        now = table.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (wanted - now[1]) / now[2]
    return small(table.select("source", "source_size", "turn", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target")))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """One row per document: words taken and, for each pass that takes some, the training time.

    The documents of a source queue by a hash of their id. Of the whole queue
    the first ``round(target)`` words are taken, going round again where the
    target exceeds the source. Columns: doc_id, source, n_copy (rows that share
    doc_id, source and size queue together only by order), size, source_size,
    target, taken, passes (array of pass, taken, position), position (first).
    NULL or empty text has size 0 and takes nothing; NULL is a source; repeated
    rows queue as rows; an empty table gives no rows.
    """
    rows = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))).alias("_key")))
    targets = source_targets(rows, weights, share, passes)
    queue = running_sum(rows, ["source"], ["_key", "doc_id", "size"], F.col("size"), "_end")
    both = queue.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source")))
    goal, begin = F.floor(F.col("target") + 0.5), F.col("_end") - F.col("size")
    steps = []
    for k in range(passes):
        at = begin + F.col("source_size") * k
        got = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - at))
        when = F.lit(None).cast("double")
        for j, knots in enumerate(schedules):
            when = F.when(F.col("turn") % len(schedules) == j, time_at(at / goal, knots)).otherwise(when)
        steps.append(F.struct(F.lit(k + 1).alias("pass"), got.alias("taken"), F.when(got > 0, when).alias("position")))
    out = both.withColumn("passes", F.filter(F.array(*steps), lambda s: s["taken"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, s: a + s["taken"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", F.get("passes", F.lit(0))["position"].alias("position"))


def training_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed documents in training order: one row per pass, cut where the mix takes only part of a text.

    Rows that share id, source and size get the entries of ``mixed`` in any
    order, one each, so no row is multiplied; rows beyond the entries of their
    key are left out. Both sides are numbered within the key.
    """
    names, keys = docs.columns, ["_k0", "_k1", "_k2"]
    key = lambda i, s, n: [F.coalesce(i.cast("string"), F.lit("-")).alias("_k0"), F.coalesce(F.concat(F.lit("+"), s), F.lit("-")).alias("_k1"), n.alias("_k2")]
    entry = numbered(mixed.select(*key(F.col("doc_id"), F.col("source"), F.col("size")), "passes"), keys, [F.xxhash64("passes")], "_n")
    left = docs.select(F.struct(*names).alias("_row"), *key(F.col("doc_id"), F.col("source"), word_count(F.col("text"))))
    rows = numbered(left, keys, [F.xxhash64(F.to_json("_row"))], "_n").join(entry.withColumnRenamed("passes", "_steps"), [*keys, "_n"])
    given = rows.select("_row", F.explode("_steps").alias("_step"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), F.lit(1), F.col("_step.taken").cast("int")), "")
    text = F.when(F.col("_step.taken") < word_count(F.col("_row.text")), head).otherwise(F.col("_row.text"))
    return given.orderBy("_step.position", "_row.doc_id").select(*[text.alias(n) if n == "text" else F.col(f"_row.`{n}`").alias(n) for n in names])


SQL = rf"""with rows_ as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5(concat_ws('|', 'mix', doc_id::varchar)) k from documents),
 src as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1)::bigint turn from rows_ group by source),
 weighted as (select *, [3.0::double, 1.0::double, 2.0::double][(turn % 3 + 1)::integer] weight, 2 * source_size cap from src),
 ranked as (select *, cap / weight ratio, row_number() over (order by cap / weight, turn) rn from weighted),
 levels as (select rn, ratio, ({SHARE} * (select sum(source_size) from src) - coalesce(sum(cap) over (order by rn rows between unbounded preceding and 1 preceding), 0))
   / nullif(sum(weight) over (order by rn rows between current row and unbounded following), 0) lvl from ranked),
 lvl as (select coalesce((select lvl from levels where ratio > lvl order by rn limit 1), 0) lvl),
 targets as (select source, source_size, turn, least(cap::double, lvl * weight) target from weighted, lvl),
 queue as (select r.doc_id, r.source, size, sum(size) over (partition by r.source order by k, doc_id, size rows unbounded preceding) - size begin_, source_size, target, floor(target + 0.5) goal, turn
   from rows_ r join targets t on r.source is not distinct from t.source),
 taken as (select *, greatest(0, least(size, goal - begin_))::bigint t1, greatest(0, least(size, goal - source_size - begin_))::bigint t2 from queue),
 at_ as (select *, case when t1 > 0 then begin_ / goal end u from taken)
 select doc_id, size, source_size, target, t1 + t2 taken,
   case turn % 3 when 0 then 0.0 + 2.0 * (u * 2.0 - 0.0) / (3.0 + sqrt(9.0 + -4.0 * (u * 2.0 - 0.0)))
     when 1 then 0.0 + 2.0 * (u * 1.0 - 0.0) / (1.0 + sqrt(1.0 + 0.0 * (u * 1.0 - 0.0)))
     else case when u * 1.0 < 0.25 then 0.0 + 2.0 * (u * 1.0 - 0.0) / (0.5 + sqrt(0.25 + 0.0 * (u * 1.0 - 0.0)))
       else 0.5 + 2.0 * (u * 1.0 - 0.25) / (0.5 + sqrt(0.25 + 8.0 * (u * 1.0 - 0.25))) end end "position"
 from at_"""


@query("op1_mixing", "documents", sql=SQL)
def op1(documents: DataFrame) -> DataFrame:
    """Words each document gives to the mix, in training order; documents not reached come last."""
    out = mix(documents).select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
