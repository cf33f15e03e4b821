"""Contrasts, bootstraps, permutation nulls, rank statistics, decisions and weights."""

from pyspark.sql import functions as F

from ..functions.hashing import unit_interval
from ..operators import profiles as pf
from ..operators import statistics as st
from ..operators import weights as wt
from ..operators.ranking import average_ranks, exact_quantiles, top_k
from . import fixtures as fx
from .fixtures import SEED, UNITS
from .null_queries import SCORED, scored
from .profile_queries import PREDICTIONS, predictions
from .registry import query

r6 = lambda c, name: F.round(c, 6).alias(name)
NULLS = ["sham_a", "sham_b", "sham_c"]


def arms(t):
    """Real score per event and three null scores, with the contrasts."""
    u = fx.units(t)
    real = F.log1p("value")
    x = u.withColumn("real", real)
    for n in NULLS:
        x = x.withColumn(n, F.col("real") * unit_interval(F.lit(n), "event_id") * 1.2)
    c = st.contributions(F.col("real"), {n: F.col(n) for n in NULLS})
    return x.select("event_id", "ts", "subject_id", "session_id", "record_id", "item_id", "event_type", "k", "value", "real", *NULLS, *[v.alias(k) for k, v in c.items()])


def _sham(n):
    return f"ln(1 + value) * (('0x' || substr(sha256(concat_ws('|', '{n}', event_id)), 1, 8))::bigint / 4294967296.0::double) * 1.2::double {n}"


ARMS = UNITS + ", arms0 as (select *, ln(1 + value) v_real, " + ", ".join(_sham(n) for n in NULLS) + """ from units),
 arms as (select *, v_real - (sham_a + sham_b + sham_c) / 3 u_oof, v_real - greatest(sham_a, sham_b, sham_c) u_min, v_real - sham_a real_minus_sham_a from arms0),
 subj_u as (select subject_id, avg(u_oof) u_oof, avg(u_min) u_min from arms group by 1)"""


@query("contribution_scores", "with " + ARMS + " select event_id, round(u_oof, 6) u_oof, round(u_min, 6) u_min, round(real_minus_sham_a, 6) real_minus_sham_a, round(u_oof - u_min, 6) selection_gap from arms")
def contribution_scores(t):
    a = arms(t)
    return a.select("event_id", *[r6(F.col(c), c) for c in ("u_oof", "u_min", "real_minus_sham_a")], r6(F.col("u_oof") - F.col("u_min"), "selection_gap"))


def entity_u(t, metric="u_oof"):
    return arms(t).groupBy("subject_id").agg(F.avg(metric).alias("u"))


def boot_sql(source, value, n, seed=SEED):
    """SQL of the draws: source(entity, value) with hash indexes."""
    return f"""ranked as (select row_number() over (order by entity) - 1 i, entity, v from (select {source})), n as (select count(*) n from ranked),
 draws as (select d draw, avg(r.v) estimate from (select unnest(range({n})) d), ranked s, n join ranked r on r.i = ('0x' || substr(sha256(concat_ws('|', {seed}, d, s.i)), 1, 15))::bigint % n.n group by 1)"""


CI = "round(quantile_cont(estimate, 0.025), 6) ci_low, round(quantile_cont(estimate, 0.975), 6) ci_high"


@query("cluster_bootstrap", "with " + ARMS + ", " + boot_sql("subject_id entity, u_min v from subj_u", "u_min", 500) + f"""
 select (select round(avg(v), 6) from ranked) estimate, (select count(*) from ranked)::bigint n_entities, (select count(*) filter (v > 0) from ranked)::bigint positive_entities, {CI} from draws""")
def cluster_bootstrap(t):
    b = st.cluster_bootstrap(entity_u(t, "u_min"), "subject_id", "u", 500, SEED)
    return b.select(r6(F.col("estimate"), "estimate"), "n_entities", "positive_entities", r6(F.col("ci_low"), "ci_low"), r6(F.col("ci_high"), "ci_high"))


@query("paired_bootstrap", "with " + ARMS + ", " + boot_sql("subject_id entity, u_oof - u_min v from subj_u", "d", 300) + f"""
 select (select round(avg(v), 6) from ranked) estimate, (select count(*) from ranked)::bigint n_entities, (select count(*) filter (v > 0) from ranked)::bigint positive_entities, {CI} from draws""")
def paired_bootstrap(t):
    d = st.paired_differences(entity_u(t, "u_min"), entity_u(t, "u_oof"), "subject_id", "u")
    b = st.cluster_bootstrap(d, "subject_id", "difference", 300, SEED)
    return b.select(r6(F.col("estimate"), "estimate"), "n_entities", "positive_entities", r6(F.col("ci_low"), "ci_low"), r6(F.col("ci_high"), "ci_high"))


@query("group_bootstrap_accuracy", "with " + PREDICTIONS + ", g as (select source entity, avg((prediction = quality)::int) v from preds group by 1), " + boot_sql("entity, v from g", "v", 500) + f"""
 select (select round(avg((prediction = quality)::int), 6) from preds) estimate, (select count(*) from ranked)::bigint n_entities, {CI} from draws""")
def group_bootstrap_accuracy(t):
    """Group means are resampled; the row mean is reported."""
    hit = F.when(F.col("prediction") == F.col("quality"), 1.0).otherwise(0.0)
    p = predictions(t).withColumn("hit", hit)
    b = st.cluster_bootstrap(p.groupBy("source").agg(F.avg("hit").alias("v")), "source", "v", 500, SEED, p.agg(F.avg("hit")))
    return b.select(r6(F.col("estimate"), "estimate"), "n_entities", r6(F.col("ci_low"), "ci_low"), r6(F.col("ci_high"), "ci_high"))


PERM = PREDICTIONS + """, dr as (select unnest(range(100)) d), bl as (select source, count(*) n, count(*) filter (quality = 0) l0, count(*) filter (quality = 1) l1, count(*) filter (prediction = 0) p0 from preds group by 1),
 xs as (select *, unnest(range(greatest(0, p0 + l0 - n), least(l0, p0) + 1)) x from bl),
 pm as (select source, x, exp(lgamma(l0 + 1) - lgamma(x + 1) - lgamma(l0 - x + 1) + lgamma(n - l0 + 1) - lgamma(p0 - x + 1) - lgamma(n - l0 - p0 + x + 1) - lgamma(n + 1) + lgamma(p0 + 1) + lgamma(n - p0 + 1)) p from xs),
 cd as (select source, x, sum(p) over (partition by source order by x) c from pm),
 us as (select *, ('0x' || substr(sha256(concat_ws('|', 20260813, d, source, 0, 0)), 1, 13))::bigint / 4503599627370496.0::double u from bl, dr),
 tb as (select d, us.source, any_value(l1 - p0) rest, coalesce(min(x) filter (c >= u), max(x)) x from us join cd using (source) group by 1, 2),
 sz as (select quality, count(*)::double n from preds group by 1),
 h as (select d, 0 quality, sum(x) hits from tb group by 1 union all select d, 1, sum(rest + x) from tb group by 1),
 rc as (select d, sum(hits / n) / (select count(*) from sz) recall from h join sz using (quality) group by 1)"""


SHUFFLED = PREDICTIONS + """, dr as (select unnest(range(100)) d), sh as (select d, source, quality, row_number() over (partition by d, source order by sha256(concat_ws('|', 20260813, d, doc_id)), doc_id) p from preds, dr),
 sl as (select source, prediction, row_number() over (partition by source order by doc_id) p from preds), sz as (select quality, count(*)::double n from preds group by 1),
 h as (select d, quality, count(*) hits from sh join sl using (source, p) where quality = prediction group by 1, 2),
 rc as (select d, sum(hits / n) / (select count(*) from sz) recall from h join sz using (quality) group by 1)"""


@query("permutation_null", "with " + SHUFFLED + """ select count(*)::bigint draws, round(quantile_cont(r, 0.95), 6) q95, round(avg(r), 6) mean_recall from (select coalesce(recall, 0) r from dr left join rc using (d))""")
def permutation_null(t):
    p = st.shuffled_labels_null(predictions(t), "doc_id", "source", "quality", "prediction", 100, SEED)
    return p.agg(F.count(F.lit(1)).alias("draws"), r6(F.percentile("recall", F.lit(0.95)), "q95"), r6(F.avg("recall"), "mean_recall"))  # one value per draw


@query("positive_control_summary", "with " + PERM + """, o as (select avg(r) r from (select quality, avg((prediction = quality)::int) r from preds group by 1)), q as (select quantile_cont(coalesce(recall, 0), 0.95) q95 from dr left join rc using (d))
 select round(r, 6) balanced_recall, round(q95, 6) q95, r > q95 passed from o, q""")
def positive_control_summary(t):
    x = predictions(t)
    p = st.permutation_null(x, "doc_id", "source", "quality", "prediction", 100, SEED).agg(F.percentile("recall", F.lit(0.95)).alias("q95"))
    b = pf.balanced_recall(x, "quality", "prediction").join(F.broadcast(p))  # one row each
    return b.select(r6(F.col("balanced_recall"), "balanced_recall"), r6(F.col("q95"), "q95"), (F.col("balanced_recall") > F.col("q95")).alias("passed"))


DELTA = """, df as (select unnest([sham_a - sham_b, sham_a - sham_c, sham_b - sham_c]) d from arms), th as (select quantile_cont(d, 0.95) threshold from df)"""


@query("null_threshold", "with " + ARMS + DELTA + " select round(threshold, 6) threshold from th")
def null_threshold(t):
    return st.null_threshold(arms(t), NULLS).select(r6(F.col("threshold"), "threshold"))


@query("item_gate", "with " + ARMS + DELTA + """, m as (select item_id, subject_id, avg(u_oof) m from arms group by 1, 2) select item_id, round(greatest(median(m) - (select threshold from th) / 4, 0), 6) gate from m group by 1""")
def item_gate(t):
    a = arms(t)
    delta = st.null_threshold(a, NULLS).select((F.col("threshold") / 4).alias("threshold"))
    return st.item_gate(a, "item_id", "subject_id", "u_oof", delta).select("item_id", r6(F.col("gate"), "gate"))


RANKS = "rank() over (partition by {g} order by {x}) + (count(*) over (partition by {g}, {x}) - 1) / 2.0::double"


@query("average_ranks", "select event_id, " + RANKS.format(g="event_type", x="value") + " as rk from events")
def average_ranks_query(t):
    return average_ranks(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "rk").select("event_id", "rk")


@query("spearman", "with " + ARMS + ", r as (select event_type, " + RANKS.format(g="event_type", x="value") + " ra, " + RANKS.format(g="event_type", x="u_min") + " rb from arms) select event_type, round(corr(ra, rb), 6) rho, count(*)::bigint n from r group by 1")
def spearman(t):
    return st.spearman(arms(t).select("event_type", "value", "u_min"), "value", "u_min", ["event_type"]).select("event_type", r6(F.col("rho"), "rho"), "n")


ONE = RANKS.replace("partition by {g}, {x}", "partition by {x}").replace("partition by {g} ", "")


@query("partial_spearman", "with " + ARMS + ", r as (select " + ONE.format(x="u_oof") + " a, " + ONE.format(x="u_min") + " b, " + ONE.format(x="value") + """ c from arms), k as (select corr(a, b) ab, corr(a, c) ac, corr(b, c) bc, count(*)::bigint n from r)
 select round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) rho, n from k""")
def partial_spearman(t):
    return st.partial_spearman(arms(t), "u_oof", "u_min", ["value"]).select(r6(F.col("rho"), "rho"), "n")


@query("rank_stability", "with " + ARMS + ", m as (select session_id, item_id, avg(u_oof) m from arms group by 1, 2), r as (select session_id, item_id, " + RANKS.format(g="session_id", x="m") + """ rk from m),
 p as (select corr(a.rk, b.rk) rho from r a join r b on a.item_id = b.item_id and a.session_id < b.session_id group by a.session_id, b.session_id)
 select count(*)::bigint pairs, round(min(rho), 6) pairwise_min, round(median(rho), 6) pairwise_median, round(max(rho), 6) pairwise_max from p""")
def rank_stability(t):
    m = arms(t).groupBy("session_id", "item_id").agg(F.avg("u_oof").alias("m"))
    s = st.rank_stability(m, "session_id", "item_id", "m")
    return s.select("pairs", *[r6(F.col(c), c) for c in ("pairwise_min", "pairwise_median", "pairwise_max")])


@query("auroc", "with " + PREDICTIONS + ", r as (select quality, " + ONE.format(x="score") + " rk from preds) select round((sum(rk) filter (quality = 1) - count(*) filter (quality = 1) * (count(*) filter (quality = 1) + 1) / 2) / (count(*) filter (quality = 1) * count(*) filter (quality = 0)), 6) auroc, count(*) filter (quality = 1)::bigint positives, count(*) filter (quality = 0)::bigint negatives from r")
def auroc(t):
    return st.auroc(predictions(t), "score", "quality").withColumn("auroc", F.round("auroc", 6))


@query("weight_diagnostics", """with w as (select value x, rank() over (order by value) rk, row_number() over (order by value) i, count(*) over () n, sum(value) over () t from events)
 select max(n)::bigint "count", round(sum(case when x > 0 then -(x / t) * ln(x / t) else 0 end) / ln(max(n)), 6) normalized_entropy, round(sum((2 * i - n - 1) * x) / (max(n) * max(t)), 6) gini,
 round(quantile_cont(x, 0.05), 6) q05, round(quantile_cont(x, 0.5), 6) q50, round(quantile_cont(x, 0.95), 6) q95 from w""")
def weight_diagnostics(t):
    d = st.weight_diagnostics(t.events.select("value"), "value")
    return d.select("count", *[r6(F.col(c), c) for c in ("normalized_entropy", "gini", "q05", "q50", "q95")])


@query("weight_recovery", "with " + ARMS + ", s as (select subject_id, avg(u_oof) a, avg(value) b from arms group by 1), r as (select " + ONE.format(x="a") + " ra, " + ONE.format(x="b") + """ rb from s),
 q as (select quantile_cont(a, 0.75) qa, quantile_cont(b, 0.75) qb, avg(a) ma, avg(b) mb from s)
 select round((select corr(ra, rb) from r), 6) rho, round(avg(abs(a / greatest(ma, 1e-8) - b / greatest(mb, 1e-8))), 6) normalized_absolute_error, round(count(*) filter (a >= qa and b >= qb) / count(*) filter (a >= qa or b >= qb)::double, 6) top_quartile_overlap from s, q""")
def weight_recovery(t):
    s = arms(t).groupBy("subject_id").agg(F.avg("u_oof").alias("a"), F.avg("value").alias("b"))
    r = st.recovery(s, "a", "b")
    return r.select(*[r6(F.col(c), c) for c in ("rho", "normalized_absolute_error", "top_quartile_overlap")])


@query("top_quartile_overlap", """with q as (select quantile_cont(l_quantity, 0.75) qa, quantile_cont(l_extendedprice, 0.75) qb from lineitem) select round(count(*) filter (l_quantity >= qa and l_extendedprice >= qb) / count(*) filter (l_quantity >= qa or l_extendedprice >= qb)::double, 6) top_quartile_overlap from lineitem, q""")
def top_quartile_overlap(t):
    return st.top_quartile_overlap(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(r6(F.col("top_quartile_overlap"), "top_quartile_overlap"))


@query("degeneracy_report", """with p as (select user_id, event_type, round(1 / (1 + exp(-1.2 * (json_extract_string(props, '$.k')::bigint / 50.0::double - 1))), 9) p, (value > 50)::int y from events), i as (select *, round(1.2::double * 1.2::double * p * (1 - p), 9) inf from p),
 r as (select y, """ + ONE.format(x="p") + " rp, " + ONE.format(x="inf") + """ ri from i), a as (select event_type, avg(y) acc from i group by 1),
 s as (select round(avg(y), 6) mean_y, round(avg((p > 0.2 and p < 0.8)::int), 6) band_share from i), c as (select round(corr(ri, rp), 6) rho, round((sum(rp) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6) auroc from r)
 select mean_y, band_share, rho, auroc, (select round(min(acc), 6) from a) item_accuracy_min, (select round(max(acc), 6) from a) item_accuracy_max, mean_y < 0.2 or mean_y > 0.8 mean_accuracy_outside_target, band_share < 0.05 information_band_degenerate, abs(rho) > 0.95 information_monotonic_degenerate, auroc < 0.55 measurement_auroc_below_threshold from s, c""")
def degeneracy_report(t):
    k = F.get_json_object("props", "$.k").cast("long")
    x = t.events.select("event_type", F.round(1 / (1 + F.exp(-1.2 * (k / 50.0 - 1))), 9).alias("p"), F.when(F.col("value") > 50, 1).otherwise(0).alias("y"))
    x = x.withColumn("inf", F.round(wt.fisher_information(F.lit(1.2), F.col("p")), 9))
    s = x.agg(r6(F.avg("y"), "mean_y"), r6(F.avg(F.when((F.col("p") > 0.2) & (F.col("p") < 0.8), 1.0).otherwise(0.0)), "band_share"))
    a = x.groupBy("event_type").agg(F.avg("y").alias("a")).agg(r6(F.min("a"), "item_accuracy_min"), r6(F.max("a"), "item_accuracy_max"))
    rho = st.spearman(x, "inf", "p").select(r6(F.col("rho"), "rho"))
    roc = st.auroc(x, "p", "y").select(r6(F.col("auroc"), "auroc"))
    j = s.join(F.broadcast(a)).join(F.broadcast(rho)).join(F.broadcast(roc))  # one row each
    return j.select("*", ((F.col("mean_y") < 0.2) | (F.col("mean_y") > 0.8)).alias("mean_accuracy_outside_target"), (F.col("band_share") < 0.05).alias("information_band_degenerate"),
                    (F.abs("rho") > 0.95).alias("information_monotonic_degenerate"), (F.col("auroc") < 0.55).alias("measurement_auroc_below_threshold"))


@query("plateau_step", """with d as (select user_id, day(ts) step, avg(value) m from events group by 1, 2), c as (select user_id, step, max(m) over (partition by user_id order by step) v from d),
 l as (select *, v - lag(v) over w g1, lag(v) over w - lag(v, 2) over w g2 from c window w as (partition by user_id order by step)) select user_id, min(step) filter (g1 < 0.005 and g2 < 0.005)::bigint plateau_step from l group by 1""")
def plateau_step(t):
    from pyspark.sql import Window as W

    d = t.events.groupBy("user_id", F.dayofmonth("ts").cast("long").alias("step")).agg(F.avg("value").alias("m"))
    c = d.withColumn("v", F.max("m").over(W.partitionBy("user_id").orderBy("step")))  # at most one row per day
    return st.plateau_step(c, ["user_id"], "step", "v")


@query("first_sustained_level", """with d as (select event_type, hour(ts) "level", avg(value) > 48 passed from events group by 1, 2), l as (select *, lead(passed) over (partition by event_type order by "level") nx, min("level") over (partition by event_type) lo from d)
 select event_type, min("level") filter (passed and nx and "level" > lo)::integer first_level from l group by 1""")
def first_sustained_level(t):
    d = t.events.groupBy("event_type", F.hour("ts").alias("level")).agg((F.avg("value") > 48).alias("passed"))
    return st.first_sustained_level(d, ["event_type"], "level", "passed")


@query("detection_family", "with " + ARMS + ", " + boot_sql("subject_id entity, u_oof v from subj_u", "u", 200) + """, c as (select avg(v_real - sham_a) ca, avg(v_real - sham_b) cb from arms)
 select (select count(*) filter (v > 0) from ranked)::bigint positive_entities, quantile_cont(estimate, 0.025) > 0 and (select count(*) filter (v > 0) from ranked) >= 12 and (select ca > 0 and cb > 0 from c) family_detected, '' reasons from draws""")
def detection_family(t):
    b = st.cluster_bootstrap(entity_u(t), "subject_id", "u", 200, SEED)
    c = arms(t).agg(F.avg(F.col("real") - F.col("sham_a")).alias("ca"), F.avg(F.col("real") - F.col("sham_b")).alias("cb"))
    return st.family_decision(b.join(F.broadcast(c)), ["ca", "cb"], 12).select("positive_entities", "family_detected", "reasons")  # one row each


@query("dose_response_curve", "with " + ARMS + """, lv as (select unnest([0.0, 0.25, 0.5, 1.0]::double[]) level), s as (select level, subject_id, avg(u_min + level * 0.5) u from arms, lv group by 1, 2), p as (select level, avg(u) estimate, avg((u > 0)::int) share from s group by 1)
 select level, round(estimate, 6) estimate, round(share, 6) positive_share, share >= 0.9 passed from p""")
def dose_response_curve(t):
    a = arms(t).groupBy("subject_id").agg(F.avg("u_min").alias("u0"))
    s = a.withColumn("level", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)]))).withColumn("u", F.col("u0") + F.col("level") * 0.5)
    p = s.groupBy("level").agg(F.avg("u").alias("e"), F.avg(F.when(F.col("u") > 0, 1.0).otherwise(0.0)).alias("s"))
    return p.select("level", r6(F.col("e"), "estimate"), r6(F.col("s"), "positive_share"), (F.col("s") >= 0.9).alias("passed"))


@query("disjoint_fold_summary", "with " + ARMS + """, f as (select subject_id, (('0x' || substr(sha256('sf|' || subject_id), 1, 15))::bigint % 3)::integer fold, avg(u_oof) u from arms group by 1)
 select count(*)::bigint entities, count(distinct fold)::bigint folds, (count(*) - count(distinct subject_id))::bigint repeated_entities, round(avg(u), 6) estimate from f""")
def disjoint_fold_summary(t):
    from ..functions.hashing import hash_index

    f = arms(t).groupBy("subject_id", hash_index(3, F.lit("sf"), "subject_id").cast("int").alias("fold")).agg(F.avg("u_oof").alias("u"))
    per = f.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u"))
    a = per.agg(F.count(F.lit(1)).alias("entities"), pf.count_when(F.col("n") > 1).alias("repeated_entities"), r6(F.avg("u"), "estimate"))
    return a.join(F.broadcast(f.agg(F.count_distinct("fold").alias("folds"))))  # one row each


@query("benchmark_contrasts", "with " + ARMS + """, l as (select session_id, event_type, avg(u_oof) v from arms group by 1, 2), w as (select session_id, max(v) filter (event_type = 'click') click, max(v) filter (event_type = 'view') "view" from l group by 1)
 select session_id, round(click, 6) click, round("view", 6) "view", round(click - "view", 6) click_minus_view from w""")
def benchmark_contrasts(t):
    w = arms(t).groupBy("session_id").pivot("event_type", ["click", "view"]).agg(F.avg("u_oof"))
    return w.select("session_id", r6(F.col("click"), "click"), r6(F.col("view"), "view"), r6(F.col("click") - F.col("view"), "click_minus_view"))


@query("entity_gap_summary", "with " + ARMS + " select count(*)::bigint entities, round(avg(u_oof - u_min), 6) mean_gap, count(*) filter (u_oof - u_min > 0)::bigint positive from subj_u")
def entity_gap_summary(t):
    d = st.paired_differences(entity_u(t, "u_min"), entity_u(t, "u_oof"), "subject_id", "u")
    return d.agg(F.count(F.lit(1)).alias("entities"), r6(F.avg("difference"), "mean_gap"), pf.count_when(F.col("difference") > 0).alias("positive"))


@query("best_of_selection", """with d as (select event_type, hour(ts) h, avg((value > 50)::int) acc from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by abs(acc - 0.5), h) rn from d) select event_type, h::integer selected, round(acc, 6) acc from r where rn = 1""")
def best_of_selection(t):
    d = t.events.groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("acc"))
    b = F.min_by(F.struct("h", "acc"), F.struct(F.abs(F.col("acc") - 0.5), F.col("h"))).alias("b")
    return d.groupBy("event_type").agg(b).select("event_type", F.col("b.h").alias("selected"), r6(F.col("b.acc"), "acc"))


FLOOR = """md as (select {b}, quantile_disc(raw, 0.5) med from sr where has group by {b}), fl as (select sr.*, med, case when med is null then 1 when has then raw else 0.1 * med end floored from sr left join md using ({b})),
 wt as (select *, count(*) over (partition by {b}) * floored / (sum(floored) over (partition by {b}) + 1e-8) weight from fl)"""


@query("direct_weights", "with " + ARMS + ", sr as (select session_id, record_id, avg(pow(greatest(u_min, 0), 0.5)) raw, avg(pow(greatest(u_min, 0), 0.5)) > 0 has from arms group by 1, 2), " + FLOOR.format(b="session_id") + " select record_id, session_id, round(weight, 6) weight, not has and med is not null floor_hit from wt")
def direct_weights(t):
    w = wt.positive_weights(arms(t), ["session_id"], "record_id", "u_min", 0.5)
    return w.select("record_id", "session_id", r6(F.col("weight"), "weight"), "floor_hit")


INFO = ARMS + """, inf as (select *, case when event_type <> 'error' then 1.44 * (1 / (1 + exp(-1.2 * (value / 50 - 1)))) * (1 - 1 / (1 + exp(-1.2 * (value / 50 - 1)))) end info, (k % 3 > 0)::int gate from arms)"""


def info(t):
    p = 1 / (1 + F.exp(-1.2 * (F.col("value") / 50 - 1)))
    return arms(t).withColumn("info", F.when(F.col("event_type") != "error", wt.fisher_information(F.lit(1.2), p))).withColumn("gate", F.when(F.col("k") % 3 > 0, 1).otherwise(0))


@query("fisher_weights", "with " + INFO + ", sr as (select session_id, record_id, coalesce(avg(info), 0) raw, count(info) > 0 has from inf group by 1, 2), " + FLOOR.format(b="session_id") + " select record_id, session_id, round(floored, 6) floored, round(weight, 6) weight from wt")
def fisher_weights(t):
    w = wt.fisher_weights(info(t), ["session_id"], "record_id", "info")
    return w.select("record_id", "session_id", r6(F.col("floored"), "floored"), r6(F.col("weight"), "weight"))


@query("evidence_variants", "with " + INFO + """, vr as (select unnest(['V0', 'V1', 'V2']) variant), sr as (select variant || '|' || session_id b, record_id, coalesce(avg(case when info is not null and (variant = 'V0' or gate > 0) then info * (case when variant = 'V2' then greatest(u_min, 0) else 1 end) end), 0) raw, raw > 0 has from inf, vr group by 1, 2), """ + FLOOR.format(b="b") + " select split_part(b, '|', 1) variant, split_part(b, '|', 2) session_id, count(*)::bigint n, round(min(weight), 6) low, round(max(weight), 6) high, count(*) filter (not has and med is not null)::bigint floor_hits from wt group by 1, 2")
def evidence_variants(t):
    w = wt.variant_weights(info(t), ["session_id"], "record_id", "info", "gate", "u_min")
    return w.groupBy("variant", "session_id").agg(F.count(F.lit(1)).alias("n"), r6(F.min("weight"), "low"), r6(F.max("weight"), "high"), pf.count_when(F.col("floor_hit")).alias("floor_hits"))


@query("weight_variant_means", "with " + ARMS + """, g as (select unnest([0.5, 1.0, 2.0]::double[]) gamma) select gamma, record_id, round(avg(pow(greatest(u_oof, 0), gamma)), 6) raw from arms, g group by 1, 2""")
def weight_variant_means(t):
    x = arms(t).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in wt.GAMMAS])))
    s = wt.sentence_scores(x, ["gamma", "record_id"], F.pow(F.greatest(F.col("u_oof"), F.lit(0.0)), F.col("gamma")), F.lit(True))
    return s.select("gamma", "record_id", r6(F.col("raw"), "raw"))


@query("soft_response", "with " + ARMS + ", t as (select stddev_pop(u_oof) tau from arms) select event_id, round(1 / (1 + exp(-u_oof / tau)), 6) response from arms, t")
def soft_response(t):
    a = arms(t)
    tau = a.agg(F.stddev_pop("u_oof").alias("tau"))
    return a.join(F.broadcast(tau)).select("event_id", r6(wt.soft_response(F.col("u_oof"), F.col("tau")), "response"))  # one row


@query("reference_scaling", "with " + ARMS + ", s as (select avg(value) m, greatest(stddev_pop(value), 1e-8) sd from arms where event_type = 'view') select event_id, round((value - m) / sd, 6) q from arms, s")
def reference_scaling(t):
    a = arms(t)
    s = a.filter("event_type = 'view'").agg(F.avg("value").alias("m"), F.greatest(F.stddev_pop("value"), F.lit(1e-8)).alias("sd"))
    return a.join(F.broadcast(s)).select("event_id", r6((F.col("value") - F.col("m")) / F.col("sd"), "q"))  # one row


@query("restricted_observations", "with " + SCORED + """, e as (select *, exp(score - max(score) over (partition by target)) x, row_number() over (partition by target order by score desc, "position") rn from scored)
 select target, max((is_target)::int) filter (rn = 1)::integer hit, round(sum(x) filter (is_target) / sum(x), 6) target_probability from e group by 1""")
def restricted_observations(t):
    return wt.restricted_observation(scored(t), "target", "score", "position", "is_target").select("target", "hit", r6(F.col("target_probability"), "target_probability"))


@query("easiness_weights", "with " + ARMS + ", m as (select session_id, record_id, avg(1 / (1 + exp(-u_oof))) c from arms group by 1, 2) select record_id, session_id, round(count(*) over (partition by session_id) * c / (sum(c) over (partition by session_id) + 1e-8), 6) weight from m")
def easiness_weights(t):
    a = arms(t).withColumn("c", 1 / (1 + F.exp(-F.col("u_oof"))))
    w = wt.easiness_weights(a, ["session_id"], "record_id", "c")
    return w.select("record_id", "session_id", r6(F.col("weight"), "weight"))


@query("weighted_objective", "with " + ARMS + ", w as (select abs(u_oof) loss, case when k < 20 then 1.0::double else k / 50.0::double end w, value from arms) select round(avg(w * loss) + 0.1 * avg(value), 6) objective from w")
def weighted_objective(t):
    a = arms(t).select(F.abs("u_oof").alias("loss"), wt.warm_up(F.col("k") / 50.0, F.col("k"), 20).alias("w"), "value")
    return wt.weighted_objective(a, "loss", "w", F.avg("value"), 0.1).select(r6(F.col("objective"), "objective"))


BATCH = """o as (select vec_id, embedding, row_number() over (order by sha256(concat_ws('|', 20260813, 'batch', vec_id)), vec_id) - 1 p from embeddings), b as (select vec_id, embedding, p // 16 batch from o),
 pr as (select a.batch, a.vec_id l, c.vec_id r, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * c.embedding[i]::double)), 9) / 0.07 z from b a join b c using (batch)),
 s1 as (select l v, ln(sum(exp(z))) - max(z) filter (l = r) x from pr group by 1), s2 as (select r v, ln(sum(exp(z))) - max(z) filter (l = r) x from pr group by 1)"""


@query("contrastive_loss", "with " + BATCH + """ select v "row", round((s1.x + s2.x) / 2, 6) loss from s1 join s2 using (v)""")
def contrastive_loss(t):
    """Batches of 16 in hash order; only pairs inside a batch are formed."""
    from ..functions.hashing import sha256
    from ..functions.vectors import dot
    from ..operators.ranking import positions

    e = t.embeddings.select("vec_id", F.col("embedding").alias("v"), sha256(F.lit(SEED), F.lit("batch"), "vec_id").alias("h"))
    b = positions(e, [], ["h", "vec_id"], "p").select(F.floor(F.col("p") / 16).alias("batch"), "vec_id", "v")
    rows = b.groupBy("batch").agg(F.collect_list(F.struct(F.col("vec_id").alias("r"), F.col("v").alias("w"))).alias("all"))  # 16 rows
    p = b.join(rows, "batch").select("batch", F.col("vec_id").alias("l"), "v", F.explode("all").alias("o")).select("batch", "l", F.col("o.r").alias("r"), F.round(dot(F.col("v"), F.col("o.w")), 9).alias("score"))
    return wt.contrastive_loss(p, ["batch"], "l", "r", "score", 0.07).select("row", r6(F.col("loss"), "loss"))
