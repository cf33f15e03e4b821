"""Validation of whole run ledgers: their heads, their stages and every id that a stage lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import STAGE_TYPES
from .durable import durable, small
from .profiles import count_when, n_rows

KINDS = ("fit", "selection", "outer_test_read", "calibration")


def _binding_errors(inputs: Column, expected: dict[str, str], where: str) -> list[Column]:
    """Missing hashes, or hashes that are not exactly the expected ones."""
    want = F.map_from_arrays(F.array(*[F.lit(k) for k in sorted(expected)]), F.array(*[F.lit(expected[k]) for k in sorted(expected)]))
    same = F.array_sort(F.map_entries(inputs)) == F.array_sort(F.map_entries(want))
    return [F.when(inputs.isNull(), f"{where}_INPUT_HASHES_MISSING"), F.when(inputs.isNotNull() & ~same, f"{where}_INPUT_HASHES_DIFFER")]


def _listed(df: DataFrame, keys: list[Column], tests: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("error"))


def validate_run_ledger(runs: DataFrame, stages: DataFrame, ids: DataFrame, outer_roles: DataFrame, inner_roles: DataFrame, expected: dict[str, str], schema_version: int, dataset: str) -> DataFrame:
    """(run_id, stage, error, records): every rule a ledger breaks; stage is NULL for faults of the run itself.

    ``runs`` has run_id, schema_version, dataset and inputs (map of hashes);
    ``stages`` run_id, stage (its number), stage_type, outer_cell, inner_cell
    (or NULL) and inputs; ``ids`` run_id, stage, kind (see ``KINDS``) and
    record_id. ``outer_roles`` has outer_cell, record_id and role (train, test),
    ``inner_roles`` also inner_cell (train, validation). Ids are joined to the
    roles of their own cells only, and rules are told within one stage. A stage
    of an unknown outer cell is not looked at further; one whose inner cell is
    unknown or of another parent is judged as if it had none.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    none = F.lit(None).cast("long").alias("stage")
    head = _listed(runs, ["run_id", none], [
        F.when((F.col("schema_version").isNull()) | (F.col("schema_version") != schema_version) | (F.coalesce("dataset", F.lit("")) != dataset), "SCHEMA_OR_DATASET_MISMATCH"),
        F.when(blank("run_id"), "RUN_ID_EMPTY"), *_binding_errors(F.col("inputs"), expected, "RUN")])
    empty = runs.join(stages.select("run_id").distinct(), "run_id", "left_anti").select("run_id", none, F.lit("NO_STAGES").alias("error"))

    number = F.monotonically_increasing_id()
    outer = small(outer_roles.select("outer_cell").distinct().withColumn("_outer", number))
    inner = small(inner_roles.select("outer_cell", "inner_cell").distinct().withColumn("_inner", number))
    s = stages.join(outer, "outer_cell", "left").join(inner, ["outer_cell", "inner_cell"], "left")
    wrong = F.col("inner_cell").isNotNull() & F.col("_inner").isNull()
    body = _listed(s, ["run_id", "stage"], [
        F.when(~F.coalesce(F.col("stage_type"), F.lit("")).isin(STAGE_TYPES), "UNKNOWN_STAGE_TYPE"),
        F.when(F.col("_outer").isNull(), "UNKNOWN_OUTER_CELL"),
        *[F.when(F.col("_outer").isNotNull(), e) for e in (F.when(wrong, "UNKNOWN_OR_WRONG_PARENT_INNER_CELL"), *_binding_errors(F.col("inputs"), expected, "STAGE"))]])

    # ids meet their stages by broadcast and the roles by numbers of cells, so no stage's ids are brought together
    open_ = small(s.filter("_outer is not null").select("run_id", "stage", "stage_type", "_outer", "_inner", number.alias("_s")))
    kind = F.col("kind")
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    counts = [count_when(kind == k).alias(f"_{k}") for k in KINDS]
    each = ids.join(open_.select("run_id", "stage", "_s"), ["run_id", "stage"]).withColumn("_other", F.when(~known, kind))
    each = durable(each.groupBy("_s", "record_id", "_other").agg(*counts, count_when(~known).alias("_unknown")))
    mixed = each.filter("_fit > 0 and _selection > 0").groupBy("_s").agg(n_rows().alias("records")).join(open_.select("_s", "run_id", "stage"), "_s")
    mixed = mixed.select("run_id", "stage", F.lit("INNER_VALIDATION_ENTERS_FIT").alias("error"), "records")
    o = outer_roles.join(outer, "outer_cell").select("_outer", "record_id", F.col("role").alias("_or"))
    i = inner_roles.join(inner, ["outer_cell", "inner_cell"]).select("_inner", "record_id", F.col("role").alias("_ir"))
    j = each.join(open_.select("_s", "_outer", "_inner"), "_s").join(o, ["_outer", "record_id"], "left").join(i, ["_inner", "record_id"], "left")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    entry = lambda k, n: F.when(F.col(n) > 0, F.struct(k.alias("kind"), F.least(n, F.lit(2).cast("long")).alias("n")))
    entries = F.array_compact(F.array(*[entry(F.lit(k), f"_{k}") for k in KINDS], entry(F.col("_other"), "_unknown")))
    # what a listed id breaks is told by these few values, so equal ones are counted before a rule is looked at
    alike = j.groupBy("_s", blank("record_id").alias("_blank"), "_or", "_ir", entries.alias("_e")).agg(n_rows().alias("records"))
    alike = alike.join(open_.select("_s", "run_id", "stage", "stage_type", "_inner"), "_s")
    fit, selection, scoring = kind == "fit", kind == "selection", F.coalesce(F.col("stage_type"), F.lit("")) == "final_scoring"
    legal_fit = F.when(F.col("_inner").isNotNull(), is_("_ir", "train")).otherwise(is_("_or", "train"))
    listed = _listed(alike.select("*", F.explode("_e").alias("_k")).select("*", "_k.kind", "_k.n"), ["run_id", "stage", "records"], [
        F.when(F.col("_blank"), "EMPTY_ID"), F.when(F.col("n") > 1, "REPEATED_ID"), F.when(~kind.isin(*KINDS), "UNKNOWN_KIND"),
        F.when(fit & ~legal_fit, "FIT_OUTSIDE_TRAIN"), F.when(selection & ~is_("_ir", "validation"), "SELECTION_OUTSIDE_INNER_VALIDATION"),
        F.when((fit | selection) & is_("_or", "test"), "OUTER_TEST_IN_FIT_OR_SELECTION"), F.when(kind == "calibration", "TEST_TIME_CALIBRATION"),
        F.when(scoring & (fit | selection), "FINAL_SCORING_FITS_OR_SELECTS"), F.when(scoring & (kind == "outer_test_read") & ~is_("_or", "test"), "FINAL_SCORING_READS_NON_TEST"),
        F.when(~scoring & (kind == "outer_test_read"), "OUTER_TEST_READ_EARLY")])
    single = [x.withColumn("records", F.lit(1).cast("long")) for x in (head, empty, body)]
    faults = single[0].unionByName(single[1]).unionByName(single[2]).unionByName(listed).unionByName(mixed)
    return faults.groupBy("run_id", "stage", "error").agg(F.sum("records").alias("records"))
