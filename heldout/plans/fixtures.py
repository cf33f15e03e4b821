"""Views of the given tables in the shapes the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20260813
KS, KT = 6, 5


def records(t) -> DataFrame:
    """One record per (supplier, part): trials, material group, join state, eligibility."""
    li = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("trials"),
        F.bool_or(F.col("l_returnflag") != "R").alias("eligible"),
    )
    p = t.part.select(
        "p_partkey",
        F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("group_key"),
        F.when(F.col("p_size") == 50, "AMBIGUOUS").otherwise("VERIFIED").alias("join_status"),
    )
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("|", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("record_id"),
        F.col("l_suppkey").cast("string").alias("subject_id"),
        F.col("l_partkey").cast("string").alias("stimulus_id"),
        "group_key", "trials", "join_status", "eligible",
    )


RECORDS = """records as (
  select concat_ws('|', l_suppkey, l_partkey) record_id, l_suppkey::varchar subject_id, l_partkey::varchar stimulus_id,
         concat_ws('|', p_brand, p_size) group_key, count(*)::bigint trials,
         case when any_value(p_size) = 50 then 'AMBIGUOUS' else 'VERIFIED' end join_status, bool_or(l_returnflag <> 'R') eligible
  from lineitem join part on p_partkey = l_partkey group by l_suppkey, l_partkey, p_brand, p_size)"""

ELIGIBLE = RECORDS + """, eligible as (
  select * from records where eligible and stimulus_id not in (select stimulus_id from records where join_status <> 'VERIFIED'))"""

GREEDY = """ranked as (select {cell} cell, group_key, size, row_number() over (partition by {cell} order by size desc, group_hash, group_key) rn from sizes),
  walk as (
    select cell, 0::bigint rn, list_transform(range({k}), lambda z: 0::bigint) tot, null::varchar group_key, null::integer fold, 0::bigint size
    from (select distinct cell from ranked)
    union all
    select r.cell, r.rn, list_transform(w.tot, lambda x, i: case when i = list_position(w.tot, list_min(w.tot)) then x + r.size else x end),
           r.group_key, (list_position(w.tot, list_min(w.tot)) - 1)::integer, r.size
    from walk w join ranked r on r.cell = w.cell and r.rn = w.rn + 1)"""

FOLDS = ELIGIBLE + f""", subj as (
  select subject_id, sum(trials)::bigint trials, ((row_number() over (order by sum(trials) desc, subject_id) - 1) % {KS})::integer subject_fold
  from eligible group by subject_id),
  sizes as (select group_key, count(distinct stimulus_id)::bigint size, sha256(concat_ws('|', {SEED}, 'tpch', 'T1', group_key)) group_hash from eligible group by group_key),
  """ + GREEDY.format(cell="1", k=KT) + """, grp as (select group_key, size, fold text_fold from walk where rn > 0),
  assigned as (select e.*, subject_fold, text_fold from eligible e join subj using (subject_id) join grp using (group_key))"""

INNER = FOLDS + f""", cells as (select s.range::integer cell_subject, t.range::integer cell_text from range({KS}) s, range({KT}) t),
  otrain as (select a.*, cell_subject, cell_text from assigned a join cells on subject_fold <> cell_subject and text_fold <> cell_text),
  isubj as (select cell_subject, cell_text, subject_id, sum(trials)::bigint trials,
     ((row_number() over (partition by cell_subject, cell_text order by sum(trials) desc, subject_id) - 1) % {{k}})::integer inner_subject_fold
     from otrain group by cell_subject, cell_text, subject_id),
  isizes as (select cell_subject || '_' || cell_text cell, group_key, count(distinct stimulus_id)::bigint size,
     sha256(concat_ws('|', {SEED}, 'T1|outer_s' || cell_subject || '_t' || cell_text, 'inner', group_key)) group_hash from otrain group by cell_subject, cell_text, group_key),
  """ + GREEDY.replace("ranked", "iranked").replace("walk", "iwalk").replace("from sizes", "from isizes").format(cell="cell", k="{k}") + """,
  igrp as (select split_part(cell, '_', 1)::integer cell_subject, split_part(cell, '_', 2)::integer cell_text, group_key, size, fold inner_text_fold from iwalk where rn > 0),
  iassigned as (select o.*, inner_subject_fold, inner_text_fold from otrain o
     join isubj using (cell_subject, cell_text, subject_id) join igrp using (cell_subject, cell_text, group_key)),
  ifolds as (select i.range::integer inner_s, j.range::integer inner_t from range({k}) i, range({k}) j),
  iroles as (select a.*, inner_s, inner_t, case when inner_subject_fold = inner_s and inner_text_fold = inner_t then 'validation'
     when inner_subject_fold <> inner_s and inner_text_fold <> inner_t then 'train' else 'held_out_only' end as role from iassigned a, ifolds)"""


def observations(t) -> DataFrame:
    """Item observations per record: the item is the ship day."""
    return t.lineitem.groupBy(
        F.concat_ws("|", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("record_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("item_id"),
    ).agg(F.count(F.lit(1)).alias("n"))


def units(t) -> DataFrame:
    """Event units: entity, record (entity, day), session (entity, week), item, order."""
    e = t.events
    day = F.date_format("ts", "yyyy-MM-dd")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("subject_id"), day.alias("day"),
        F.concat_ws("|", F.col("user_id").cast("string"), day).alias("record_id"),
        F.weekofyear("ts").cast("string").alias("session_id"),
        F.concat_ws("|", "event_type", (k % 20).cast("string")).alias("item_id"),
        "event_type", k.alias("k"), "value",
    )


UNITS = """units as (
  select event_id, ts, user_id::varchar subject_id, strftime(ts, '%Y-%m-%d') "day", concat_ws('|', user_id, strftime(ts, '%Y-%m-%d')) record_id,
         week(ts)::varchar session_id, concat_ws('|', event_type, json_extract_string(props, '$.k')::bigint % 20) item_id, event_type,
         json_extract_string(props, '$.k')::bigint k, value from events)"""


def doc_tokens(t) -> DataFrame:
    """White-space tokens of every document with their place."""
    from ..functions.text import tokens

    return t.documents.select("doc_id", "source", "lang", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


TOKENS = r"""tokens as (
  select doc_id, source, lang, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) token from documents)"""
