"""Splits, nested splits, scopes and their checks."""

from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..operators import splits
from ..operators.durable import durable
from . import fixtures as fx
from .fixtures import ELIGIBLE, FOLDS, INNER, KS, KT, RECORDS, SEED, UNITS
from .registry import query

SPLIT = dict(seed=SEED, dataset="tpch", task="T1", ks=KS, kt=KT)


def split(t):
    return splits.joint_split(fx.records(t), **SPLIT)


def inner(t, k=3):
    a = durable(split(t)["assigned"])
    return a, splits.inner_assignments(a, seed=SEED, task="T1", k=k, ks=KS, kt=KT)


@query("exclusion_ledger", "with " + RECORDS + """, bad as (select distinct stimulus_id s from records where join_status <> 'VERIFIED')
select record_id, subject_id, stimulus_id, group_key, array_to_string(list_sort(list_filter([
  case when not eligible then 'EXPLICITLY_EXCLUDED' end, case when join_status <> 'VERIFIED' then 'MATERIAL_JOIN_NOT_VERIFIED' end,
  case when s is not null then 'STIMULUS_HAS_UNVERIFIED_JOIN' end], lambda x: x is not null)), ',') reasons
from records left join bad on s = stimulus_id where not eligible or s is not null""")
def exclusion_ledger(t):
    x = split(t)["excluded"]
    return x.select("record_id", "subject_id", "stimulus_id", "group_key", F.array_join("reasons", ",").alias("reasons"))


@query("reason_histogram", "with " + RECORDS + """, r as (
 select case when not eligible then 'EXPLICITLY_EXCLUDED' end reason from records union all
 select case when join_status <> 'VERIFIED' then 'MATERIAL_JOIN_NOT_VERIFIED' end from records union all
 select 'STIMULUS_HAS_UNVERIFIED_JOIN' from records where stimulus_id in (select stimulus_id from records where join_status <> 'VERIFIED'))
select reason, count(*)::bigint n from r where reason is not null group by reason""")
def reason_histogram(t):
    return split(t)["excluded"].select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("entity_trial_totals", "with " + FOLDS + """
select subject_fold, sum(trials)::bigint trials, count(*)::bigint subjects from subj group by subject_fold""")
def entity_trial_totals(t):
    return split(t)["subjects"].groupBy("subject_fold").agg(F.sum("trials").alias("trials"), F.count(F.lit(1)).alias("subjects"))


@query("entity_folds", "with " + FOLDS + " select subject_id, trials, subject_fold from subj")
def entity_folds(t):
    return split(t)["subjects"]


@query("material_folds", "with recursive " + FOLDS + " select group_key, size, text_fold from grp")
def material_folds(t):
    return split(t)["groups"].select("group_key", "size", "text_fold")


@query("group_sizes_and_conflicts", "with " + RECORDS + """
select group_key, count(distinct stimulus_id)::bigint stimuli,
  count(distinct case when stimulus_id in (select stimulus_id from records group by 1 having count(distinct group_key) > 1) then stimulus_id end)::bigint conflicts
from records group by group_key""")
def group_sizes_and_conflicts(t):
    pairs = fx.records(t).select("group_key", "stimulus_id").distinct()
    conflict = pairs.groupBy("stimulus_id").agg((F.count(F.lit(1)) > 1).cast("long").alias("c"))
    return pairs.join(conflict, "stimulus_id").groupBy("group_key").agg(F.count(F.lit(1)).alias("stimuli"), F.sum("c").alias("conflicts"))


CELLS = """select cell_subject, cell_text, count(*) filter (subject_fold = cell_subject and text_fold = cell_text)::bigint test_records,
  count(*) filter (subject_fold <> cell_subject and text_fold <> cell_text)::bigint train_records,
  count(*) filter ((subject_fold = cell_subject) <> (text_fold = cell_text))::bigint held_out_only_records
from assigned, (select s.range::integer cell_subject, t.range::integer cell_text from range(6) s, range(5) t) group by cell_subject, cell_text"""


@query("joint_split_cells", "with recursive " + FOLDS + CELLS)
def joint_split_cells(t):
    return splits.cell_counts(split(t)["assigned"], KS, KT)


@query("cell_role_entities", "with recursive " + FOLDS + """
select cell_subject, cell_text, case when subject_fold = cell_subject and text_fold = cell_text then 'test'
  when subject_fold <> cell_subject and text_fold <> cell_text then 'train' else 'held_out_only' end "role",
  count(distinct subject_id)::bigint subjects, count(distinct stimulus_id)::bigint stimuli, sum(trials)::bigint trials
from assigned, (select s.range::integer cell_subject, t.range::integer cell_text from range(6) s, range(5) t) group by 1, 2, 3""")
def cell_role_entities(t):
    a = durable(split(t)["assigned"])
    return splits.cell_role_totals(a, KS, KT, {"subjects": "subject_id", "stimuli": "stimulus_id"}, "trials")


@query("split_assertions", "with recursive " + FOLDS + """
select 'each_subject_has_one_fold' "rule", (select count(*) from (select subject_id from assigned group by 1 having count(distinct subject_fold) > 1))::bigint violations
union all select 'each_stimulus_has_one_fold', (select count(*) from (select stimulus_id from assigned group by 1 having count(distinct text_fold) > 1))
union all select 'group_does_not_cross_text_folds', (select count(*) from (select group_key from assigned group by 1 having count(distinct text_fold) > 1))
union all select 'all_subject_folds_populated', 6 - (select count(distinct subject_fold) from assigned)
union all select 'all_text_folds_populated', 5 - (select count(distinct text_fold) from assigned)
union all select 'all_eligible_records_assigned', (select count(*) from eligible) - (select count(*) from assigned)
union all select 'record_assigned_once', (select count(*) from (select record_id from assigned group by 1 having count(*) > 1))""")
def split_assertions(t):
    s = split(t)
    a, g, p = durable(s["assigned"]), s["groups"], s["subjects"]
    return splits.split_violations(p, g, a, KS, KT)


@query("inner_split_cells", "with recursive " + INNER.replace("{k}", "3") + """
select cell_subject, cell_text, inner_s, inner_t, count(*) filter (role = 'train')::bigint train_records,
 count(*) filter (role = 'validation')::bigint validation_records, count(*) filter (role = 'held_out_only')::bigint held_out_only_records
from iroles group by all""")
def inner_split_cells(t):
    a, i = inner(t)
    return splits.inner_cell_counts(a, i, 3, KS, KT)


OBS = """, obs as (select concat_ws('|', l_suppkey, l_partkey) record_id, strftime(l_shipdate, '%Y-%m-%d') item_id, count(*)::bigint n from lineitem group by all),
 cnt as (select cell_subject, cell_text, inner_s, inner_t, item_id, sum(n)::bigint n from iroles join obs using (record_id) where role = 'train' group by all),
 sup as (select cell_subject, cell_text, inner_s, inner_t, median(n)::double median, count(*)::bigint item_count, min(n) "min", max(n) "max" from cnt group by all)"""


@query("inner_item_support", "with recursive " + INNER.replace("{k}", "4") + OBS + " select * from sup")
def inner_item_support(t):
    a, i = inner(t, 4)
    return splits.inner_support(a, fx.observations(t), i, 4, KS, KT)


@query("inner_fold_downgrade", "with recursive " + INNER.replace("{k}", "4") + OBS + """,
 s as (select min(n) min_subjects from (select count(*)::bigint n from isubj group by cell_subject, cell_text)), m as (select min(median) min_median from sup)
select min_subjects, min_median, min_subjects < 12 subject_trigger, min_median < 10 item_trigger, min_subjects < 12 or min_median < 10 downgraded from s, m""")
def inner_fold_downgrade(t):
    a, i = inner(t, 4)
    return splits.downgrade_decision(i["subjects"], splits.inner_support(a, fx.observations(t), i, 4, KS, KT))


@query("candidate_scope_pools", "with recursive " + INNER.replace("{k}", "3") + """
select 'outer_test' scope_type, 'outer|t' || text_fold scope_id, count(distinct stimulus_id)::bigint pool from assigned group by all
union all select 'inner_validation', 'inner|s' || cell_subject || '_t' || cell_text || '|t' || inner_text_fold, count(distinct stimulus_id)::bigint from iassigned group by all""")
def candidate_scope_pools(t):
    a, i = inner(t)
    return splits.candidate_scopes(a, i["groups"]).groupBy("scope_type", "scope_id").agg(F.count(F.lit(1)).alias("pool"))


@query("three_way_parts", "with recursive " + FOLDS + """
select case when subject_fold <> 0 and text_fold <> 0 then 'fit' when subject_fold <> 0 then 'seen_entity' when text_fold = 0 then 'cross_entity' else 'unused' end part,
 count(*)::bigint records, count(distinct subject_id)::bigint subjects from assigned group by 1""")
def three_way_parts(t):
    return splits.recovery_roles(split(t)["assigned"], 0, KS, KT).groupBy("part").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("subject_id").alias("subjects"))


@query("hash_halves", "with " + UNITS + """, r as (select event_id, subject_id, row_number() over (partition by subject_id order by sha256(concat_ws('|', 20260813, 'half', event_id)), event_id) rn,
 count(*) over (partition by subject_id) n from units) select event_id, (case when rn - 1 < n // 2 then 0 else 1 end)::integer half from r""")
def hash_halves(t):
    u = fx.units(t).select("event_id", "subject_id", sha256(F.lit(SEED), F.lit("half"), "event_id").alias("h"))
    return splits.hash_halves(u, ["subject_id"], "h", "event_id").select("event_id", "half")


@query("hash_share_split", """with r as (select event_id, row_number() over (order by sha256(concat_ws('|', 20260813, 'share', event_id)), event_id) rn, count(*) over () n from events)
select event_id, case when rn - 1 < floor(n * 0.8::double) then 'train' else 'test' end part from r""")
def hash_share_split(t):
    e = t.events.select("event_id", sha256(F.lit(SEED), F.lit("share"), "event_id").alias("h"))
    return splits.share_split(e, "h", "event_id", 0.8).select("event_id", "part")


@query("duplicate_and_blank_identities", """select (select count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1))::bigint repeated,
 (select count(*) from lineitem where l_orderkey is null or l_linenumber is null)::bigint incomplete""")
def duplicate_and_blank_identities(t):
    keys = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"),
        F.sum(F.when(F.col("l_orderkey").isNull() | F.col("l_linenumber").isNull(), F.col("n")).otherwise(0)).alias("incomplete"),
    )


@query("generated_record_ids", """with d as (select sha256(concat_ws('|', user_id, event_type, strftime(ts, '%Y-%m-%d'))) h, event_id from events)
select event_id, 'r-' || h || case when row_number() over (partition by h order by event_id) = 1 then '' else '-' || row_number() over (partition by h order by event_id) end record_id from d""")
def generated_record_ids(t):
    from ..operators.ranking import positions

    e = t.events.select("event_id", sha256("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("h"))
    p = positions(e, ["h"], ["event_id"], "p")
    suffix = F.when(F.col("p") == 0, "").otherwise(F.concat(F.lit("-"), (F.col("p") + 1).cast("string")))
    return p.select("event_id", F.concat(F.lit("r-"), "h", suffix).alias("record_id"))
