"""Support, coverage, population and consistency profiles."""

from pyspark.sql import functions as F

from ..functions.hashing import unit_interval
from ..functions.text import fold_text
from ..operators import profiles as pf
from . import fixtures as fx
from .fixtures import TOKENS, UNITS
from .registry import query


@query("item_support", "with " + UNITS + """ select item_id, count(*)::bigint n_observations, count(distinct subject_id)::bigint n_subjects,
 count(*) >= 20 and count(distinct subject_id) >= 5 supported from units group by item_id""")
def item_support(t):
    return pf.item_support(fx.units(t), "item_id", "subject_id")


@query("item_support_after_dedup", "with " + UNITS + """, d as (select distinct record_id, item_id, subject_id from units)
 select item_id, count(*)::bigint n_observations, count(distinct subject_id)::bigint n_subjects, count(*) >= 20 and count(distinct subject_id) >= 5 supported from d group by item_id""")
def item_support_after_dedup(t):
    return pf.item_support(fx.units(t), "item_id", "subject_id", dedup=["record_id", "item_id"])


@query("item_support_summary", "with " + UNITS + """, i as (select item_id, count(*) n, count(distinct subject_id) s from units group by 1),
 c as (select subject_id, count(distinct item_id) items from units group by 1), o as (select list_sort(list(n)) l, count(*)::bigint m from i)
select m item_count, (select sum(n) from i)::bigint n_observations, (select count(*) from i where n >= 20 and s >= 5)::bigint supported_item_count,
 round((select count(*) from i where n >= 20 and s >= 5) / m::double, 8) supported_item_rate,
 case when (select count(*) from i where n >= 20 and s >= 5) / m::double < 0.2 then 'NO_GO' else 'PASS' end redline_status,
 (select median(n) from i)::double median, l[(m - 1) // 4 + 1]::double q1, l[3 * (m - 1) // 4 + 1]::double q3, (select count(*) from c)::bigint subject_count,
 (select sum(s) from i)::bigint observed_cells, round(1 - (select sum(s) from i)::double / (m * (select count(*) from c)), 8) sparsity,
 round((select median(items) from c)::double / m, 8) coverage_median from o""")
def item_support_summary(t):
    return pf.support_summary(fx.units(t), "item_id", "subject_id")


@query("five_number_summary", """with g as (select l_suppkey, list_sort(list(l_quantity)) l, count(*)::bigint n, median(l_quantity) m from lineitem group by 1)
select l_suppkey, n "count", l[1] "min", l[(n - 1) // 4 + 1] q1, m median, l[3 * (n - 1) // 4 + 1] q3, l[n] "max" from g""")
def five_number_summary(t):
    return pf.five_numbers(t.lineitem.select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


def metric_cells(t):
    """Metrics per (entity, day); a cell with one event is not eligible."""
    e = fx.units(t)
    return e.groupBy("subject_id", "day").agg(
        F.avg(F.col("value") / 100 - 1).alias("mean_u"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("pi_g"),
        (F.count(F.lit(1)) >= 2).alias("eligible")).withColumn("exclusion_reason", F.lit("TOO_FEW_EVENTS"))


METRIC_CELLS = UNITS + """, cells as (select subject_id, "day", avg(value / 100 - 1) mean_u, avg(case when value > 50 then 1.0::double else 0 end) pi_g, count(*) >= 2 eligible from units group by 1, 2)"""


@query("entity_first_means", "with " + METRIC_CELLS + """ select subject_id, count(*)::bigint n_eligible_cells, round(avg(mean_u), 6) mean_u, round(avg(pi_g), 6) pi_g from cells where eligible group by 1""")
def entity_first_means(t):
    m, _ = pf.entity_first(metric_cells(t), "subject_id", "day", ["mean_u", "pi_g"])
    return m.select("subject_id", "n_eligible_cells", F.round("mean_u", 6).alias("mean_u"), F.round("pi_g", 6).alias("pi_g"))


@query("entity_first_exclusions", "with " + METRIC_CELLS + """ select subject_id, "day", 'TOO_FEW_EVENTS' reason from cells where not eligible""")
def entity_first_exclusions(t):
    _, x = pf.entity_first(metric_cells(t), "subject_id", "day", ["mean_u", "pi_g"])
    return x.select("subject_id", "day", "reason")


@query("mean_cascade", "with " + UNITS + """, a as (select subject_id, record_id, item_id, avg(value) value from units group by 1, 2, 3), b as (select subject_id, record_id, avg(value) value from a group by 1, 2)
 select subject_id, round(avg(value), 6) value from b group by 1""")
def mean_cascade(t):
    u = fx.units(t)
    m = pf.mean_cascade(u, [["subject_id", "record_id", "item_id"], ["subject_id", "record_id"], ["subject_id"]], ["value"])
    return m.select("subject_id", F.round("value", 6).alias("value"))


@query("fold_then_entity_means", "with " + UNITS + """, f as (select subject_id, session_id, avg(value) value from units group by 1, 2),
 s as (select subject_id, avg(value) value, count(*)::bigint folds from f group by 1)
 select count(*)::bigint subjects, round(avg(value), 6) value, min(folds) min_folds, max(folds) max_folds, min(folds) = max(folds) equal_folds from s""")
def fold_then_entity_means(t):
    f = fx.units(t).groupBy("subject_id", "session_id").agg(F.avg("value").alias("value"))
    s = f.groupBy("subject_id").agg(F.avg("value").alias("value"), pf.n_rows().alias("folds"))
    return s.agg(pf.n_rows().alias("subjects"), F.round(F.avg("value"), 6).alias("value"), F.min("folds").alias("min_folds"), F.max("folds").alias("max_folds"),
                 (F.min("folds") == F.max("folds")).alias("equal_folds"))


def predictions(t):
    """A length rule predicting the quality label, per document source."""
    d = t.documents.select("doc_id", "source", "n_chars", "lang")
    return t.labels.join(d, "doc_id").withColumn("prediction", F.when(F.col("n_chars") > 1000, 1).otherwise(0)) \
        .withColumn("score", unit_interval(F.lit("score"), "doc_id") + F.col("quality") * 0.2)


PREDICTIONS = """preds as (select l.doc_id, quality, toxic, source, n_chars, lang, case when n_chars > 1000 then 1 else 0 end prediction,
  ('0x' || substr(sha256(concat_ws('|', 'score', l.doc_id)), 1, 8))::bigint / 4294967296.0::double + quality * 0.2::double score from labels l join documents d using (doc_id))"""


@query("balanced_recall", "with " + PREDICTIONS + """, c as (select quality, avg((prediction = quality)::int) r from preds group by 1)
 select round(avg(r), 6) balanced_recall, count(*)::bigint classes from c""")
def balanced_recall(t):
    b = pf.balanced_recall(predictions(t), "quality", "prediction")
    return b.select(F.round("balanced_recall", 6).alias("balanced_recall"), "classes")


@query("balanced_recall_by_group", "with " + PREDICTIONS + """, c as (select source, quality, avg((prediction = quality)::int) r from preds group by 1, 2)
 select source, round(avg(r), 6) balanced_recall, count(*)::bigint classes from c group by 1""")
def balanced_recall_by_group(t):
    b = pf.balanced_recall(predictions(t), "quality", "prediction", ["source"])
    return b.select("source", F.round("balanced_recall", 6).alias("balanced_recall"), "classes")


@query("gate_precision_recall", "with " + PREDICTIONS + """, c as (select count(*) filter (quality = 1 and prediction = 1)::bigint tp, count(*) filter (quality <> 1 and prediction = 1)::bigint fp, count(*) filter (quality = 1 and prediction <> 1)::bigint fn from preds)
 select tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) f1 from c""")
def gate_precision_recall(t):
    p = pf.precision_recall(predictions(t), F.col("quality") == 1, F.col("prediction") == 1)
    return p.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("class_support", """select c.label, count(e.vec_id)::bigint n from (select range::integer as label from range(12)) c left join embeddings e on e.label = c.label group by c.label""")
def class_support(t):
    classes = t.spark.range(12).select(F.col("id").cast("int").alias("label"))
    return pf.class_support(t.embeddings.select("label"), "label", classes)


@query("coverage_levels", """select source, lang, count(*)::bigint targets, count(*) filter (n_chars >= 500)::bigint available, round(count(*) filter (n_chars >= 500) / count(*)::double, 6) coverage
 from documents group by grouping sets ((source, lang), (source), ())""")
def coverage_levels(t):
    c = pf.coverage_levels(t.documents.select("source", "lang", "n_chars"), [["source", "lang"], ["source"], []], F.col("n_chars") >= 500)
    return c.withColumn("coverage", F.round("coverage", 6))


@query("population_profile", """with g as (select n_chars >= 500 eligible, list_sort(list(n_chars)) l, count(*)::bigint n, median(n_chars) m, count(distinct source)::bigint sources from documents group by 1)
 select eligible, n "count", l[1] "min", l[(n - 1) // 4 + 1] q1, m median, l[3 * (n - 1) // 4 + 1] q3, l[n] "max", sources from g""")
def population_profile(t):
    d = t.documents.select("source", "n_chars", (F.col("n_chars") >= 500).alias("eligible"))
    return pf.five_numbers(d, ["eligible"], "n_chars").join(d.groupBy("eligible").agg(F.count_distinct("source").alias("sources")), "eligible")


@query("functional_dependency_conflicts", """select n_nationkey::varchar k, count(distinct o_orderpriority)::bigint variants, 'nation->priority' rule
 from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1 having count(distinct o_orderpriority) > 1
 union all select c_custkey::varchar, count(distinct c_nationkey), 'customer->nation' from customer group by 1 having count(distinct c_nationkey) > 1""")
def functional_dependency_conflicts(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    a = pf.dependency_conflicts(j, ["n_nationkey"], "o_orderpriority").select(F.col("n_nationkey").cast("string").alias("k"), "variants", F.lit("nation->priority").alias("rule"))
    b = pf.dependency_conflicts(t.customer, ["c_custkey"], "c_nationkey").select(F.col("c_custkey").cast("string").alias("k"), "variants", F.lit("customer->nation").alias("rule"))
    return a.unionByName(b)


@query("inventory_by_day", """with e as (select strftime(ts, '%Y-%m-%d') "day", event_type, count(*) n from events group by 1, 2), x as (select unnest(['click', 'error', 'purchase', 'view', 'never']) event_type)
 select d."day", sum(coalesce(n, 0))::bigint n, count(*) filter (n is null)::bigint missing_types, string_agg(x.event_type, ',' order by x.event_type) filter (n is null) missing
 from (select distinct "day" from e) d cross join x left join e on e."day" = d."day" and e.event_type = x.event_type group by 1""")
def inventory_by_day(t):
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").groupBy("day", "event_type").agg(pf.n_rows().alias("n"))
    expected = [F.lit(x) for x in ("click", "error", "purchase", "view", "never")]
    per = e.groupBy("day").agg(F.collect_set("event_type").alias("have"), F.sum(F.when(F.col("event_type").isin("click", "error", "purchase", "view", "never"), F.col("n"))).alias("n"))
    gone = F.array_sort(F.array_except(F.array(*expected), F.col("have")))
    return per.select("day", "n", F.size(gone).cast("long").alias("missing_types"), F.array_join(gone, ",").alias("missing"))


@query("material_profile", """select source, count(*)::bigint n, min(length(text))::bigint min_width, max(length(text))::bigint max_width, count(distinct text)::bigint unique_texts,
 count(distinct lang)::bigint conditions, (count(*) - count(distinct text))::bigint duplicate_texts from documents group by source""")
def material_profile(t):
    d = t.documents.select("source", "lang", F.char_length("text").alias("w"), F.sha2("text", 256).alias("h"))
    return d.groupBy("source").agg(pf.n_rows().alias("n"), F.min("w").cast("long").alias("min_width"), F.max("w").cast("long").alias("max_width"),
                                   F.count_distinct("h").alias("unique_texts"), F.count_distinct("lang").alias("conditions")) \
        .withColumn("duplicate_texts", F.col("n") - F.col("unique_texts"))


@query("duplicate_text_groups", """select sha256(replace(lower(trim(text)), 'ß', 'ss')) h, count(*)::bigint copies, count(distinct text)::bigint exact_variants, min(doc_id) first_doc from documents group by 1 having count(*) > 1""")
def duplicate_text_groups(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("x"), F.sha2(fold_text(F.col("text")), 256).alias("h"))
    per = d.groupBy("h", "x").agg(pf.n_rows().alias("n"), F.min("doc_id").alias("d"))
    return per.groupBy("h").agg(F.sum("n").alias("copies"), pf.n_rows().alias("exact_variants"), F.min("d").alias("first_doc")).filter("copies > 1")


@query("robust_statistics", """with q as (select event_type, quantile_cont(value, 0.001) q001, quantile_cont(value, 0.01) q01, median(value) median, quantile_cont(value, 0.99) q99, quantile_cont(value, 0.999) q999, min(value) "min", max(value) "max", count(*) filter (value is null)::bigint nonfinite from events group by 1),
 m as (select event_type, median(abs(value - q.median)) mad from events join q using (event_type) group by 1)
 select event_type, round(q001, 6) q001, round(q01, 6) q01, round(median, 6) median, round(q99, 6) q99, round(q999, 6) q999, "min", "max", nonfinite, round(mad, 6) mad from q join m using (event_type)""")
def robust_statistics(t):
    r = pf.robust_statistics(t.events.select("event_type", "value"), ["event_type"], "value")
    return r.select("event_type", "min", "max", "nonfinite", *[F.round(c, 6).alias(c) for c in ("q001", "q01", "median", "q99", "q999", "mad")])


@query("event_collapse", """select user_id, strftime(ts, '%Y-%m-%d %H') "hour", bool_or(coalesce(value < 200, false)) finite, bool_or(case when event_type = 'view' then null else value > 100 end) flagged,
 case when min(k) = max(k) then min(k) else -1 end page, count(*)::bigint samples from (select *, json_extract_string(props, '$.k')::bigint k from events) group by 1, 2""")
def event_collapse(t):
    e = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), (F.col("value") < 200).alias("finite"),
                        F.when(F.col("event_type") != "view", F.col("value") > 100).alias("flagged"), F.get_json_object("props", "$.k").cast("long").alias("page"))
    return pf.collapse_events(e, ["user_id", "hour"], ["finite"], ["flagged"], "page")


@query("single_global_offset", """select count(distinct l_orderkey - o_orderkey)::bigint offsets, min(l_orderkey - o_orderkey) min_offset, max(l_orderkey - o_orderkey) max_offset, count(*)::bigint "rows", count(distinct l_orderkey - o_orderkey) = 1 single_global_offset
 from lineitem join orders on o_orderkey = l_orderkey""")
def single_global_offset(t):
    j = t.lineitem.select("l_orderkey").join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pf.single_offset(j, F.col("l_orderkey"), F.col("o_orderkey"))


@query("signature_uniformity", """select label, count(distinct len(embedding))::bigint widths, min(len(embedding))::bigint width, case when min(len(embedding)) <> max(len(embedding)) then 'INCONSISTENT' when min(len(embedding)) <> 64 then 'UNEXPECTED' else 'CONSISTENT' end status from embeddings group by label""")
def signature_uniformity(t):
    e = t.embeddings.select("label", F.size("embedding").cast("long").alias("width"))
    return pf.evidence_status(e, ["label"], "width", 64).join(e.groupBy("label").agg(F.count_distinct("width").alias("widths")), "label") \
        .select("label", "widths", F.col("low").alias("width"), "status")


@query("page_crossing", """with s as (select conv_id, length(text) sentence, count(distinct turn // 4)::bigint pages from conversations group by 1, 2)
 select conv_id, count(*)::bigint sentences, count(*) filter (pages > 1)::bigint crossing, count(*) filter (pages = 1)::bigint single from s group by 1""")
def page_crossing(t):
    c = t.conversations.select("conv_id", F.char_length("text").alias("sentence"), F.floor(F.col("turn") / 4).alias("page"))
    s = c.groupBy("conv_id", "sentence").agg(F.count_distinct("page").alias("pages"))
    return s.groupBy("conv_id").agg(pf.n_rows().alias("sentences"), pf.count_when(F.col("pages") > 1).alias("crossing"), pf.count_when(F.col("pages") == 1).alias("single"))


@query("structural_negative_bound", """select source, count(distinct doc_id)::bigint pool, count(distinct doc_id)::bigint - 1 max_negatives, case when count(distinct doc_id) - 1 >= 49 then 'POSSIBLE' else 'STRUCTURALLY_IMPOSSIBLE' end status from documents group by source""")
def structural_negative_bound(t):
    return pf.structural_bound(t.documents, "source", "doc_id")


@query("item_frequency_surprisal", "with " + TOKENS + """, f as (select token, count(*) f from tokens group by 1)
 select doc_id, round(avg(f), 6) mean_frequency, round(avg(-ln(greatest(f, 1))), 6) surprisal from tokens join f using (token) group by doc_id""")
def item_frequency_surprisal(t):
    per = fx.doc_tokens(t).groupBy("doc_id", "token").agg(pf.n_rows().alias("n"))  # copies merge before the join
    f = per.groupBy("token").agg(F.sum("n").alias("f"))
    j = per.join(f, "token")
    n = F.sum("n")
    return j.groupBy("doc_id").agg(F.round(F.sum(F.col("f") * F.col("n")) / n, 6).alias("mean_frequency"),
                                   F.round(F.sum(-F.log(F.greatest(F.col("f"), F.lit(1))) * F.col("n")) / n, 6).alias("surprisal"))


@query("count_matrix", """select user_id, count(*) filter (event_type = 'click')::bigint click, count(*) filter (event_type = 'error')::bigint error, count(*) filter (event_type = 'purchase')::bigint purchase, count(*) filter (event_type = 'view')::bigint "view" from events group by user_id""")
def count_matrix(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "view"]).agg(pf.n_rows()).na.fill(0)


@query("full_grid_coverage", """select n.n_name, s.c_mktsegment, count(c.c_custkey)::bigint n, count(c.c_custkey) > 0 covered, case when count(c.c_custkey) = 0 then 'NO_CUSTOMER' end reason
 from nation n cross join (select distinct c_mktsegment from customer) s left join customer c on c.c_nationkey = n.n_nationkey and c.c_mktsegment = s.c_mktsegment group by 1, 2""")
def full_grid_coverage(t):
    facts = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment")
    return pf.full_grid(t.nation.select("n_name"), t.customer.select("c_mktsegment").distinct(), facts, ["n_name", "c_mktsegment"], "NO_CUSTOMER")


@query("expected_inventory", """with e as (select user_id, strftime(ts, '%Y-%m-%d') "day", count(*)::bigint n from events group by 1, 2)
 select u.user_id, d."day", coalesce(n, 0)::bigint n, case when n is null then 'MISSING' when n > 8 then 'DUPLICATE' else 'PRESENT' end status
 from (select distinct user_id from events) u cross join (select distinct "day" from e) d left join e on e.user_id = u.user_id and e."day" = d."day" """)
def expected_inventory(t):
    e = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    g = pf.full_grid(e.select("user_id").distinct(), e.select("day").distinct(), e, ["user_id", "day"])
    return g.select("user_id", "day", "n", F.when(~F.col("covered"), "MISSING").when(F.col("n") > 8, "DUPLICATE").otherwise("PRESENT").alias("status"))


@query("nested_inventory", r"""with l as (select conv_id, turn, unnest(string_split(text, chr(10))) line from conversations)
 select conv_id, count(distinct turn)::bigint turns, count(*)::bigint leaves, count(*) filter (trim(line) = '')::bigint empty, count(*) filter (trim(line) <> '' and line ~ '^[[:upper:]ÉÈÇÄÖÜÊÑÍÓ]')::bigint valid,
 count(*) filter (trim(line) <> '' and not line ~ '^[[:upper:]ÉÈÇÄÖÜÊÑÍÓ]')::bigint malformed from l group by conv_id""")
def nested_inventory(t):
    c = t.conversations.select("conv_id", "turn", F.explode_outer(F.split("text", "\n")).alias("line"))
    empty = F.trim("line") == ""
    good = F.col("line").rlike("^[A-ZÉÈÇÄÖÜÊÑÍÓ]")
    per = c.groupBy("conv_id", "turn").agg(pf.n_rows().alias("l"), pf.count_when(empty).alias("e"), pf.count_when(~empty & good).alias("v"), pf.count_when(~empty & ~good).alias("m"))
    return per.groupBy("conv_id").agg(pf.n_rows().alias("turns"), F.sum("l").alias("leaves"), F.sum("e").alias("empty"), F.sum("v").alias("valid"), F.sum("m").alias("malformed"))
