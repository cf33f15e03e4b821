"""Composed steps: prepared cells, ledger-gated cross-fits, valid unit sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import scoring_gate
from .durable import durable, small
from .features import apply_robust, fit_robust
from .nulls import cycle_donors
from .probes import cross_fit
from .profiles import item_support
from .ranking import positions


def prepare_cells(rows: DataFrame, *, row: str, fold: str, folds: int, item: str, entity: str, record: str, value: str, seed,
                  min_rows: int = 20, min_entities: int = 5) -> DataFrame:
    """For every fold at once: scaled values, item support and null arm, all settled by the fold's own train rows.

    Adds cell, part (train or validation), z, z_null (a donor unit of the same
    record) and supported. Rows without a donor or support stay, marked.
    """
    cells = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cells = durable(cells.withColumn("part", F.when(F.col("cell") == F.col(fold), "validation").otherwise("train")))
    train = cells.filter("part = 'train'")
    state = fit_robust(train, ["cell"], value)
    keyed = train.withColumn("_ci", F.concat_ws("|", F.col("cell").cast("string"), item))
    support = item_support(keyed, "_ci", entity, min_rows, min_entities).filter("supported").select("_ci")
    scaled = apply_robust(cells, state, ["cell"], value)
    marked = scaled.withColumn("_ci", F.concat_ws("|", F.col("cell").cast("string"), item)).join(
        small(support).withColumn("supported", F.lit(True)), "_ci", "left").withColumn("supported", F.coalesce("supported", F.lit(False))).drop("_ci")
    return cycle_donors(marked, ["cell", "part", record], row, seed, "within_record", {"z": "z_null"}).withColumnRenamed("reason", "null_reason")


def cell_summary(prepared: DataFrame) -> DataFrame:
    """Rows, common rows (a null arm exists), and rows that may be fitted or scored, per cell and part."""
    common = F.col("z_null").isNotNull()
    return prepared.groupBy("cell", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.when(common, 1).otherwise(0)).alias("common_rows"),
        F.sum(F.when(common & F.col("supported"), 1).otherwise(0)).alias("usable_rows"))


def gated_cross_fit(df: DataFrame, ledger: DataFrame, roles: DataFrame, cell: list[str], **fit) -> DataFrame:
    """Cross-fitted predictions, handed out only if the run ledger is clean against the roles."""
    scoring_gate(ledger, roles, cell)
    return cross_fit(df, **fit)


def valid_sequence(units: DataFrame, record: str, order: list[str], status: str) -> tuple[DataFrame, DataFrame]:
    """(valid units numbered in order inside their record, records without any valid unit)."""
    good = units.filter(F.col(status) == "VALID")
    empty = units.groupBy(record).agg(F.max(F.when(F.col(status) == "VALID", 1).otherwise(0)).alias("_v")).filter("_v = 0").select(record)
    return positions(good, [record], order, "sequence_index"), empty
