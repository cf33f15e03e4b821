"""Prepared cells, gated fits, decisions and validations of composed tables."""

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import decisions as dc
from ..operators import protocol as pr
from ..operators import splits
from ..operators import statistics as st
from ..operators.durable import durable
from . import fixtures as fx
from .feature_queries import FOLD_UNITS, RIDGE, fold_units, xy
from .fixtures import SEED, UNITS
from .null_queries import SCORED, SETS, scored, sets
from .profile_queries import METRIC_CELLS, metric_cells
from .registry import query
from .statistic_queries import ARMS, CI, arms, boot_sql, entity_u

r6 = lambda c, name: F.round(c, 6).alias(name)


@query("cell_preparation", "with " + UNITS + """, u as (select *, (('0x' || substr(sha256('sf|' || subject_id), 1, 15))::bigint % 3)::integer sf from units), c as (select u.*, cell, case when sf = cell then 'validation' else 'train' end part from u, (select range::integer cell from range(3))),
 s as (select cell, item_id from c where part = 'train' group by 1, 2 having count(*) >= 20 and count(distinct subject_id) >= 5), n as (select *, count(*) over (partition by cell, part, record_id) siblings from c)
 select n.cell, part, count(*)::bigint "rows", count(*) filter (siblings > 1)::bigint common_rows, count(*) filter (siblings > 1 and s.item_id is not null)::bigint usable_rows from n left join s on s.cell = n.cell and s.item_id = n.item_id group by 1, 2""")
def cell_preparation(t):
    u = fx.units(t).join(fold_units(t).select("event_id", "sf"), "event_id").select("event_id", "sf", "item_id", "subject_id", "record_id", "value")
    p = pr.prepare_cells(u, row="event_id", fold="sf", folds=3, item="item_id", entity="subject_id", record="record_id", value="value", seed=SEED)
    return pr.cell_summary(p)


@query("ledger_gated_cross_fit", "with " + RIDGE + " select sf, tf, count(*)::bigint n, round(avg(pow(y - (w1 * x1 + w2 * x2 + b), 2)), 6) squared_error from fu join md on s = sf and t = tf group by 1, 2")
def ledger_gated_cross_fit(t):
    """The ledger of all cells is written and validated before any row is scored."""
    d = durable(xy(t))
    roles = splits.cell_roles(d.select(F.col("event_id").alias("record_id"), "sf", "tf"), 3, 2, "sf", "tf")
    cell = ["cell_subject", "cell_text"]
    p = pr.gated_cross_fit(d, au.build_ledger(roles, cell, "record_id", "gate"), roles, cell, x="x", y="y", d=2, ks=3, kt=2, sf="sf", tf="tf")
    return p.groupBy("sf", "tf").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(F.col("y")[0] - F.col("prediction")[0], 2)), "squared_error"))


@query("valid_unit_sequence", "with " + UNITS + """, d as (select subject_id, "day", count(*) n, avg(value) m from units group by 1, 2) select subject_id, "day", (row_number() over (partition by subject_id order by "day") - 1)::bigint sequence_index, round(m, 6) m from d where n >= 3""")
def valid_unit_sequence(t):
    d = fx.units(t).groupBy("subject_id", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    d = d.withColumn("status", F.when(F.col("n") >= 3, "VALID").otherwise("TOO_SHORT"))
    return pr.valid_sequence(d, "subject_id", ["day"], "status")[0].select("subject_id", "day", "sequence_index", r6(F.col("m"), "m"))


@query("population_faults", "with " + METRIC_CELLS + """, s as (select subject_id, count(*) filter (eligible) n from cells group by 1) select subject_id, 'NO_ELIGIBLE_CELL' fault from s where n < 12""")
def population_faults(t):
    s = metric_cells(t).groupBy("subject_id").agg((F.sum(F.when(F.col("eligible"), 1).otherwise(0)) - 11).alias("cells"))
    return dc.population_errors(s, "subject_id", "cells")


@query("candidate_set_faults", "with " + SETS + """ select s.target, case when e.label = 3 then 'TARGET_NOT_IN_SET,POSITION_GAP' when e.label = 4 then 'REPEATED_CANDIDATE' when e.label = 5 then 'POSITION_GAP' else 'UNKNOWN_CANDIDATE' end faults
 from (select distinct target from sets) s join embeddings e on e.vec_id = s.target where e.label in (3, 4, 5, 6)""")
def candidate_set_faults(t):
    """Label 3 loses the target's own entry, 4 names a member twice, 5 loses its last or first other entry, 6 names an unknown item."""
    s = sets(t).join(t.embeddings.select(F.col("vec_id").alias("target"), "label"), "target")
    other = ~F.col("is_target")
    last = s.filter(other).groupBy("target").agg(F.max("position").alias("_last"), F.min_by("candidate", "position").alias("_first"))
    s = s.join(last, "target")
    at_last = other & (F.col("position") == F.col("_last"))
    changed = F.when((F.col("label") == 4) & at_last, F.col("_first")).when((F.col("label") == 6) & at_last, F.lit(-1).cast("long")).otherwise(F.col("candidate"))
    spoiled = s.filter(~((F.col("label") == 3) & F.col("is_target")) & ~((F.col("label") == 5) & at_last)).withColumn("candidate", changed)
    return dc.candidate_set_faults(spoiled, "target", "candidate", "position", t.embeddings, "vec_id", 10)


@query("bottleneck_labels", "with " + ARMS + """, g as (select event_type, avg(u_oof) > 1.45 seen, avg(u_min) > 0.5 crossed from arms group by 1) select event_type, case when seen and not crossed then 'TRANSFER_DOMINANT' when not seen and not crossed then 'REPRESENTATION_OR_PROBE_DOMINANT' when seen and crossed then 'BASELINE_REPRODUCTION_DEVIATION' else 'UNEXPECTED_REGIME_ORDERING' end label from g""")
def bottleneck_labels(t):
    g = arms(t).groupBy("event_type").agg((F.avg("u_oof") > 1.45).alias("seen"), (F.avg("u_min") > 0.5).alias("crossed"))
    return g.select("event_type", dc.bottleneck(F.col("seen"), F.col("crossed")).alias("label"))


@query("recovery_selection", "with " + ARMS + """, r as (select event_type, session_id, avg(u_min) e, count(distinct subject_id) n from arms group by 1, 2), p as (select event_type, count(*) filter (e > 0 and n >= 10) passed, min(e) filter (e > 0 and n >= 10) score, string_agg(session_id, ',' order by session_id) filter (e > 0 and n >= 10) tasks from r group by 1)
 select event_type selected, tasks, case when passed = (select count(distinct session_id) from arms) then 'PASS_ALL_TASKS' else 'PASS_LIMITED' end outcome from p order by passed desc, score desc, event_type limit 1""")
def recovery_selection(t):
    r = arms(t).groupBy("event_type", "session_id").agg(F.avg("u_min").alias("estimate"), F.count_distinct("subject_id").alias("positive_entities"))
    r = r.withColumn("ci_low", F.col("estimate")).withColumn("family_detected", F.lit(True))
    return dc.select_candidate(r, "event_type", "session_id")


@query("admission_outcome", "with " + ARMS + """, r as (select session_id, event_type, avg(u_min) e from arms group by 1, 2), p as (select session_id, bool_and(e > 0.3) ok, bool_and(e > 0) weak from r group by 1)
 select case when count(*) filter (ok) = count(*) then 'PASS_BOTH' when count(*) filter (ok) = 1 and bool_and(ok or weak) then 'PASS_LIMITED_ONE_TASK' else 'FAIL' end outcome, count(*) filter (ok)::bigint tasks_passed from p""")
def admission_outcome(t):
    r = arms(t).groupBy("session_id", "event_type").agg(F.avg("u_min").alias("estimate"))
    r = r.select("session_id", "event_type", "estimate", (F.col("estimate") > 0.3).alias("passed"), F.lit(True).alias("diagnostics_pass"), (-F.abs("estimate")).alias("ci_low"), F.abs("estimate").alias("ci_high"))
    return dc.combined_admission(r, "session_id", "event_type")


@query("scorer_control", "with " + SCORED + ", g as (select label entity, avg(((\"rank\" = 1)::int)) v from ranks join embeddings on vec_id = target group by 1), " + boot_sql("entity, v from g", "v", 200) + f"""
 select (select round(avg(v), 6) from ranked) macro_hit_rate, round(quantile_cont(estimate, 0.025), 6) ci_low, quantile_cont(estimate, 0.025) > 0 and (select avg(v) from ranked) >= 0.8 passed from draws""")
def scorer_control(t):
    from ..operators.sampling import target_ranks

    r = target_ranks(scored(t), "target", "score", "position", "is_target").join(t.embeddings.select(F.col("vec_id").alias("target"), "label"), "target")
    g = durable(r.groupBy("label").agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("v")))
    b = st.cluster_bootstrap(g, "label", "v", 200, SEED)
    return b.select(r6(F.col("estimate"), "macro_hit_rate"), r6(F.col("ci_low"), "ci_low"), dc.scorer_control_passes(F.col("ci_low"), F.col("estimate")).alias("passed"))


@query("interval_signs", "with " + ARMS + ", " + boot_sql("subject_id entity, u_oof v from subj_u", "u", 200) + """ select 'POSITIVE' sign, (select count(*) from ranked)::bigint n_entities from draws having quantile_cont(estimate, 0.025) > 0""")
def interval_signs(t):
    b = st.cluster_bootstrap(entity_u(t), "subject_id", "u", 200, SEED)
    return b.select(st.sign_of_interval(F.col("estimate"), F.col("ci_low"), F.col("ci_high")).alias("sign"), "n_entities")


@query("outcome_with_reasons", """select 3::bigint checks, case when (select count(*) from events where value < 0) + (select count(*) from lineitem where l_quantity <= 0) + (select count(*) from orders where o_orderstatus = 'P') = 0 then 'PASS' else 'INVALID' end outcome,
 case when (select count(*) from orders where o_orderstatus = 'P') > 0 then 'no_pending_orders' else '' end reasons""")
def outcome_with_reasons(t):
    checks = au.check_rows({"values_not_negative": t.events.filter("value < 0"), "quantities_positive": t.lineitem.filter("l_quantity <= 0"), "no_pending_orders": t.orders.filter("o_orderstatus = 'P'")})
    return dc.outcome_of(checks, "PASS", "INVALID")
