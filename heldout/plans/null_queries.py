"""Null controls, candidate sampling and retrieval ranks."""

from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..functions.vectors import dot
from ..operators import nulls
from ..operators.sampling import hash_first, sampled_sets, small_pools, target_ranks
from ..operators.statistics import auroc
from . import fixtures as fx
from .fixtures import SEED, UNITS
from .registry import query


def cyc(group, arm):
    return f"""select *, row_number() over (partition by {group} order by sha256(concat_ws('|', 20260813, '{arm}', {group}, event_id)), event_id) - 1 p, count(*) over (partition by {group}) n from units"""


@query("unit_cycle_within_record", "with " + UNITS + ", r as (" + cyc("record_id", "within") + """)
 select a.event_id, case when a.n > 1 then b.event_id end donor_event, case when a.n > 1 then b.value end donor_value, case when a.n < 2 then 'FEWER_THAN_TWO_UNITS' end reason
 from r a join r b on a.record_id = b.record_id and b.p = (a.p + 1) % a.n""")
def unit_cycle_within_record(t):
    u = fx.units(t).select("event_id", "record_id", "value")
    return nulls.cycle_donors(u, ["record_id"], "event_id", SEED, "within", {"event_id": "donor_event", "value": "donor_value"}) \
        .select("event_id", "donor_event", "donor_value", "reason")


@query("unit_cycle_within_entity", "with " + UNITS + ", r as (" + cyc("subject_id", "entity") + """)
 select a.event_id, b.event_id donor_event from r a join r b on a.subject_id = b.subject_id and b.p = (a.p + 1) % a.n""")
def unit_cycle_within_entity(t):
    u = fx.units(t).select("event_id", "subject_id")
    return nulls.cycle_donors(u, ["subject_id"], "event_id", SEED, "entity", {"event_id": "donor_event"}).select("event_id", "donor_event")


PERM = """perm as (select vec_id, label, embedding, list_transform(list_sort(list_transform(range(8), lambda j: {'h': sha256(concat_ws('|', 20260813, 'channel_block_permutation', vec_id, j)), 'j': j})), lambda s: s.j) o from embeddings),
 blk as (select vec_id, label, embedding, flatten(list_transform(range(8), lambda j: embedding[o[list_position(o, j) % 8 + 1] * 8 + 1 : o[list_position(o, j) % 8 + 1] * 8 + 8])) moved from perm)"""


@query("block_permutation", "with " + PERM + """ select vec_id, moved[1]::double first_value, moved[9]::double block_value, moved[64]::double last_value, round(list_sum(list_transform(list_zip(embedding, moved), lambda z: z[1]::double * z[2]::double)), 6) overlap from blk""")
def block_permutation(t):
    b = nulls.block_permutation(t.embeddings, "embedding", 8, 8, SEED, "vec_id", "moved")
    at = lambda i: F.element_at("moved", i).cast("double")
    return b.select("vec_id", at(1).alias("first_value"), at(9).alias("block_value"), at(64).alias("last_value"), F.round(dot(F.col("embedding"), F.col("moved")), 6).alias("overlap"))


@query("donor_matching")
def donor_matching(t):
    """Donors within (entity, week): other day, similar number of events."""
    r = fx.units(t).groupBy("subject_id", "session_id", "record_id", "day").agg(F.count(F.lit(1)).alias("unit_count"))
    return nulls.match_donors(r, ["subject_id", "session_id"], "record_id", "day", "unit_count", SEED)


@query("donor_matching_guarantees", """select 0::bigint self_donors, 0::bigint same_group, 0::bigint bad_length, 0::bigint repeated_donors, true targets_equal_donors,
 (select count(*) from (select distinct user_id, strftime(ts, '%Y-%m-%d') from events))::bigint records""")
def donor_matching_guarantees(t):
    from ..functions.parsing import length_legal
    from ..operators.durable import durable
    from ..operators.profiles import count_when

    m = durable(donor_matching(t))
    ok = m.filter("donor_id is not null")
    a = m.agg(count_when(F.col("donor_id") == F.col("record_id")).alias("self_donors"), count_when(F.col("donor_group") == F.col("day")).alias("same_group"),
              count_when(~length_legal(F.col("unit_count"), F.col("donor_units"))).alias("bad_length"), F.count(F.lit(1)).alias("records"))
    r = ok.groupBy("donor_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_donors"))
    x = ok.select("record_id").exceptAll(ok.select(F.col("donor_id").alias("record_id"))).agg((F.count(F.lit(1)) == 0).alias("targets_equal_donors"))
    return a.join(F.broadcast(r)).join(F.broadcast(x))  # one row each


@query("position_resampling", "with " + UNITS + """, r as (select event_id, record_id, row_number() over (partition by record_id order by ts, event_id) - 1 p, count(*) over (partition by record_id) n from units)
 select event_id, (case when n <= 1 then 0 else round_even(p * (5 - 1) / (n - 1), 0) end)::bigint donor_position from r""")
def position_resampling(t):
    from ..operators.ranking import positions

    u = fx.units(t).select("event_id", "record_id", "ts")
    n = u.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    p = positions(u, ["record_id"], ["ts", "event_id"], "p").join(n, "record_id")
    return p.select("event_id", nulls.resample_position(F.col("p"), F.col("n"), F.lit(5)).alias("donor_position"))


@query("four_arm_support", "with " + UNITS + ", a as (" + cyc("record_id", "within") + "), b as (" + cyc("subject_id", "entity") + """), x as (
 select a1.event_id, a1.value v_real, case when a1.n > 1 then a2.value end w_value from a a1 join a a2 on a1.record_id = a2.record_id and a2.p = (a1.p + 1) % a1.n),
 y as (select b1.event_id, b2.value e_value from b b1 join b b2 on b1.subject_id = b2.subject_id and b2.p = (b1.p + 1) % b1.n where b1.n > 1),
 l as (select unnest([{'arm': 'real', 'x': v_real}, {'arm': 'within', 'x': w_value}, {'arm': 'entity', 'x': e_value}]) s from x join y using (event_id) where w_value is not null)
 select s.arm arm, count(*)::bigint n, round(avg(s.x), 6) mean_x from l group by 1""")
def four_arm_support(t):
    u = fx.units(t).select("event_id", "record_id", "subject_id", "value")
    a = nulls.cycle_donors(u, ["record_id"], "event_id", SEED, "within", {"value": "within"}).drop("reason")
    b = nulls.cycle_donors(u, ["subject_id"], "event_id", SEED, "entity", {"value": "entity"}).select("event_id", "entity")
    s = nulls.stack_arms(a.join(b, "event_id"), ["event_id"], {"real": "value", "within": "within", "entity": "entity"})
    return s.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean_x"))


@query("graded_injection", """with x as (select vec_id, label, unnest(range(1, 65)) dim, embedding from embeddings), e as (select vec_id, label, dim, embedding[dim]::double v from x), m as (select label, dim, round(avg(v), 6) code from e group by 1, 2)
 select vec_id, level, dim::integer dim, round(v + level * code, 6) x from e join m using (label, dim), (select unnest([0, 0.25, 0.5, 1.0]::double[]) level)""")
def graded_injection(t):
    """The mean vector of each label, added in four strengths to its members; all dimensions."""
    each = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "v"))
    means = each.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))
    codes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("code"))  # one entry per dimension
    e = t.embeddings.join(codes, "label").select("vec_id", F.col("embedding").alias("x"), "code")
    g = nulls.graded_injection(e, "x", "code", [0, 0.25, 0.5, 1.0]).select("vec_id", "level", F.posexplode("injected").alias("dim", "x"))
    return g.select("vec_id", "level", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("x"))


@query("first_k_by_hash", """select doc_id, source, rn::bigint "rank" from (select doc_id, source, row_number() over (partition by source order by sha256(concat_ws('|', 20260813, 'smoke', doc_id)), doc_id) rn from documents) where rn <= 5""")
def first_k_by_hash(t):
    return hash_first(t.documents.select("doc_id", "source"), ["source"], "doc_id", 5, SEED, "smoke")


SETS = """ring as (select vec_id, label, embedding, row_number() over (partition by label order by sha256(concat_ws('|', 20260813, 'pool', vec_id)), vec_id) - 1 p, count(*) over (partition by label) n from embeddings),
 negs as (select r.vec_id target, r.label, (r.p + 1 + (r.n - 1) * j // 9 + (('0x' || substr(sha256(concat_ws('|', 20260813, 'draw', r.vec_id, j)), 1, 15))::bigint % ((r.n - 1) * (j + 1) // 9 - (r.n - 1) * j // 9))) % r.n q, j from ring r, (select unnest(range(9)) j) where r.n > 9),
 members as (select target, x.vec_id candidate, false is_target from negs join ring x on x.label = negs.label and x.p = q union all select vec_id, vec_id, true from ring where n > 9),
 sets as (select *, row_number() over (partition by target order by sha256(concat_ws('|', 20260813, 'order', target, candidate)), candidate)::bigint - 1 as "position" from members)"""

SCORED = SETS + """, scored as (select s.*, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 9) score from sets s join embeddings a on a.vec_id = target join embeddings b on b.vec_id = candidate),
 ranks as (select target, count(*) filter (score > ts or (score = ts and "position" < tp))::bigint + 1 "rank" from (select *, max(score) filter (is_target) over (partition by target) ts, max("position") filter (is_target) over (partition by target) tp from scored) group by target)"""


def sets(t):
    return sampled_sets(t.embeddings.select("vec_id", "label"), ["label"], "vec_id", 10, SEED)


def scored(t):
    head = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    a, b = head.toDF("target", "tv"), head.toDF("candidate", "cv")
    return sets(t).join(a, "target").join(b, "candidate").withColumn("score", F.round(dot(F.col("tv"), F.col("cv")), 9)).drop("tv", "cv")


@query("sampled_candidate_sets", "with " + SETS + """ select target, candidate, is_target, "position" from sets""")
def sampled_candidate_sets(t):
    return sets(t).select("target", "candidate", "is_target", "position")


@query("small_pools", """select source, lang, count(*)::bigint n, 'POOL_BELOW_SET_SIZE' reason from documents group by 1, 2 having count(*) < 15""")
def small_pool_query(t):
    return small_pools(t.documents, ["source", "lang"], 15)


@query("target_ranks", "with " + SCORED + """ select target, "rank" from ranks""")
def target_rank_query(t):
    return target_ranks(scored(t), "target", "score", "position", "is_target")


@query("retrieval_metrics_by_entity", "with " + SCORED + """, m as (select label, avg(("rank" = 1)::int) r1, avg(1.0::double / "rank") mrr from ranks join embeddings on vec_id = target group by 1)
 select round(avg(r1), 6) macro_r1, round(avg(mrr), 6) macro_mrr, count(*)::bigint entities from m""")
def retrieval_metrics_by_entity(t):
    r = target_ranks(scored(t), "target", "score", "position", "is_target").join(t.embeddings.select(F.col("vec_id").alias("target"), "label"), "target")
    m = r.groupBy("label").agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("r1"), F.avg(1.0 / F.col("rank")).alias("mrr"))
    return m.agg(F.round(F.avg("r1"), 6).alias("macro_r1"), F.round(F.avg("mrr"), 6).alias("macro_mrr"), F.count(F.lit(1)).alias("entities"))


@query("paired_verification", "with " + SCORED + """, f as (select target, is_target, score, row_number() over (partition by target, is_target order by "position") rn from scored),
 v as (select score, is_target::int y from f where rn = 1), r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double rk from v)
 select round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6) auroc, count(*) filter (y = 1)::bigint positives, count(*) filter (y = 0)::bigint negatives from r""")
def paired_verification(t):
    s = scored(t)
    first = s.filter(~F.col("is_target")).groupBy("target").agg(F.min_by("score", "position").alias("score")).select("score", F.lit(0).alias("y"))
    v = s.filter("is_target").select("score", F.lit(1).alias("y")).unionByName(first)
    return auroc(v, "score", "y").withColumn("auroc", F.round("auroc", 6))


@query("candidate_log_probability", "with " + SCORED + """, e as (select target, is_target, score / 0.07 z, max(score / 0.07) over (partition by target) m from scored)
 select target, round(max(z - m) filter (is_target) - ln(sum(exp(z - m))), 6) log_probability from e group by target""")
def candidate_log_probability(t):
    from ..operators.probes import log_probability

    return log_probability(scored(t), ["target"], "score", "is_target", 0.07).withColumn("log_probability", F.round("log_probability", 6))


@query("evenly_spaced_sample", """select vec_id, round(list_sum(list_transform(range(32), lambda i: embedding[floor(i * (len(embedding) - 1) / 31.0::double)::bigint + 1]::double)), 6) s, embedding[1]::double "first", embedding[64]::double "last" from embeddings""")
def evenly_spaced_sample(t):
    from ..functions.vectors import evenly_spaced

    e = t.embeddings.select("vec_id", evenly_spaced(F.col("embedding")).alias("a"))
    return e.select("vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("s"), F.col("a")[0].cast("double").alias("first"), F.col("a")[31].cast("double").alias("last"))
