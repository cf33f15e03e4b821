"""Outcome rules over statistics tables: columns and small grouped tables, each with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import n_rows


def bottleneck(seen: Column, cross: Column) -> Column:
    """Where a signal is lost, from detection on seen entities and across entities."""
    return (F.when(seen & ~cross, "TRANSFER_DOMINANT").when(~seen & ~cross, "REPRESENTATION_OR_PROBE_DOMINANT")
            .when(seen & cross, "BASELINE_REPRODUCTION_DEVIATION").otherwise("UNEXPECTED_REGIME_ORDERING"))


def class_control_passes(ci_low: Column, observed: Column, null_q95: Column, classes: int = 8) -> Column:
    return (ci_low > 1.0 / classes) & (observed > null_q95)


def scorer_control_passes(ci_low: Column, macro_hit_rate: Column, minimum: float = 0.80) -> Column:
    return (ci_low > 0) & (macro_hit_rate >= minimum)


def paired_worse(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every comparison of a group is below zero with its whole interval."""
    return comparisons.groupBy(*keys).agg(F.bool_and((F.col("estimate") < 0) & (F.col("ci_high") < 0)).alias("uniformly_worse"))


def select_candidate(rows: DataFrame, candidate: str, task: str, minimum_positive: int = 10) -> DataFrame:
    """One row: the candidate that passes most tasks, then the best worst-case gain, then the name; and the outcome.

    ``rows`` has family_detected, ci_low, positive_entities and estimate per (candidate, task).
    """
    ok = F.col("family_detected") & (F.col("ci_low") > 0) & (F.col("positive_entities") >= minimum_positive)
    per = rows.groupBy(candidate).agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("passed"), F.min(F.when(ok, F.col("estimate"))).alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col(task)))), ",").alias("tasks"))  # tasks are a handful
    best = F.min_by(F.struct(candidate, "passed", "tasks"), F.struct(-F.col("passed"), -F.coalesce("score", F.lit(float("-inf"))), F.col(candidate)))
    total = rows.agg(F.count_distinct(task).alias("_all"))
    top = per.agg(best.alias("b")).join(F.broadcast(total))  # one row each
    outcome = F.when(F.col("b.passed") == 0, "FAIL").when(F.col("b.passed") == F.col("_all"), "PASS_ALL_TASKS").otherwise("PASS_LIMITED")
    return top.select(F.when(F.col("b.passed") > 0, F.col(f"b.{candidate}")).alias("selected"), F.col("b.tasks").alias("tasks"), outcome.alias("outcome"))


def outcome_of(checks: DataFrame, good: str, bad: str) -> DataFrame:
    """One row from (check, outcome) rows: the outcome word and the sorted names that failed."""
    failed = F.array_sort(F.collect_set(F.when(F.col("outcome") != "PASS", F.col("check"))))  # checks are a fixed list
    a = checks.agg(failed.alias("f"), n_rows().alias("checks"))
    return a.select("checks", F.when(F.size("f") == 0, good).otherwise(bad).alias("outcome"), F.array_join("f", ",").alias("reasons"))


def combined_admission(rows: DataFrame, task: str, basis: str) -> DataFrame:
    """One row over (task, basis) results: pass on all tasks, on one with the other merely underpowered, or fail.

    ``rows`` has passed, diagnostics_pass and, per metric, estimate, ci_low and ci_high.
    """
    weak = (F.col("estimate") > 0) & (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    per = rows.groupBy(task).agg(F.bool_and("passed").alias("ok"), F.bool_and(weak).alias("weak"), F.bool_and("diagnostics_pass").alias("diag"))
    a = per.agg(F.bool_and("diag").alias("diag"), F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("n_ok"), n_rows().alias("n"),
                F.bool_and(F.col("ok") | F.col("weak")).alias("rest_weak"))
    return a.select(F.when(F.col("diag") & (F.col("n_ok") == F.col("n")), "PASS_BOTH").when(F.col("diag") & (F.col("n_ok") == 1) & F.col("rest_weak"), "PASS_LIMITED_ONE_TASK")
                    .otherwise("FAIL").alias("outcome"), F.col("n_ok").alias("tasks_passed"))


def population_errors(subjects: DataFrame, entity: str, cells: str) -> DataFrame:
    """Faults of an entity-level table: blank, repeated, or without an eligible cell."""
    blank = F.coalesce(F.trim(F.col(entity)), F.lit("")) == ""
    one = subjects.filter(blank).select(entity, F.lit("BLANK_ENTITY").alias("fault"))
    two = subjects.groupBy(entity).agg(n_rows().alias("_n")).filter("_n > 1").select(entity, F.lit("REPEATED_ENTITY").alias("fault"))
    three = subjects.filter(F.coalesce(F.col(cells), F.lit(0)) < 1).select(entity, F.lit("NO_ELIGIBLE_CELL").alias("fault"))
    return one.unionByName(two).unionByName(three)


def candidate_set_faults(sets: DataFrame, target: str, candidate: str, position: str, vocabulary: DataFrame, item: str, size: int) -> DataFrame:
    """Faulty candidate sets of ``size`` members: target missing, repeated or unknown members, places 0..size-1 not all taken."""
    known = vocabulary.select(F.col(item).alias(candidate), F.lit(True).alias("_known"))
    j = sets.join(known, candidate, "left")
    own = F.sum(F.when(F.col(candidate) == F.col(target), 1).otherwise(0))
    a = j.groupBy(target).agg(own.alias("_own"), n_rows().alias("_n"), F.count_distinct(candidate).alias("_d"),
                              F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("_u"), F.min(position).alias("_lo"), F.max(position).alias("_hi"), F.count_distinct(position).alias("_p"))
    faults = F.array_compact(F.array(
        F.when(F.col("_own") != 1, "TARGET_NOT_IN_SET"), F.when(F.col("_d") != F.col("_n"), "REPEATED_CANDIDATE"),
        F.when(F.col("_u") > 0, "UNKNOWN_CANDIDATE"), F.when((F.col("_lo") != 0) | (F.col("_hi") != size - 1) | (F.col("_n") != size) | (F.col("_p") != size), "POSITION_GAP")))
    return a.select(target, F.array_join(faults, ",").alias("faults")).filter("faults <> ''")
