"""Identity joins with ledgers, lookups with reasons, dictionary codes and record grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import first_reason
from .durable import durable
from .profiles import every_pair
from .ranking import positions


def checked_observations(observations: DataFrame, records: DataFrame, record: str, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(observations whose identity agrees with their record, faulty ones with a reason)."""
    r = records.select(record, F.lit(True).alias("_known"), *[F.col(c).alias(f"_r_{c}") for c in identity])
    j = observations.join(r, record, "left")
    blank, differs = F.lit(False), F.lit(False)
    for c in [record, *identity]:
        blank = blank | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    for c in identity:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    why = first_reason((blank, "EMPTY_REQUIRED_FIELD"), (F.col("_known").isNull(), "UNKNOWN_RECORD"), (differs, "IDENTITY_MISMATCH"))
    j = j.withColumn("reason", why).drop("_known", *[f"_r_{c}" for c in identity])
    return j.filter("reason is null").drop("reason"), j.filter("reason is not null")


def lookup_with_reasons(events: DataFrame, table: DataFrame, on: list[str], rules) -> DataFrame:
    """Left join to a lookup table and the first rule that fails, in the order given.

    ``rules`` see the joined columns and ``_found``. Spark broadcasts the table if it is small.
    """
    j = events.join(table.withColumn("_found", F.lit(True)), on, "left")
    return j.withColumn("reason", first_reason((F.col("_found").isNull(), "UNKNOWN_KEY"), *rules)).drop("_found")


def legal_donor_counts(trials: DataFrame, bucket: list[str], record: str, group: str, units: str) -> DataFrame:
    """Legal donors per record: same bucket, other group, unit counts within 0.75 to 1.25.

    Counted from two running sums (all groups minus the own group), without forming pairs.
    """
    from .candidates import band_counts

    every = band_counts(trials, bucket, units, "_all")
    own = band_counts(trials, [*bucket, group], units, "_own")
    j = trials.join(every, [*bucket, units]).join(own, [*bucket, group, units])
    return j.select(*bucket, record, (F.col("_all") - F.col("_own")).alias("legal_donors"))


def encode(df: DataFrame, item: str, out: str = "code") -> DataFrame:
    """Dictionary of distinct ids with zero-based codes in id order."""
    return positions(df.select(item).distinct(), [], [item], out)


def decode(codes: DataFrame, dictionary: DataFrame, code: str, item: str, per: list[str]) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, faults: codes out of range or repeated inside ``per``)."""
    d = dictionary.select(F.col("code").alias(code), item)
    good = codes.join(d, code)
    outside = codes.join(d, code, "left_anti").select(*per, code, F.lit("OUT_OF_RANGE").alias("fault"))
    twice = codes.groupBy(*per, code).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*per, code, F.lit("REPEATED").alias("fault"))
    return good, outside.unionByName(twice)


def record_table(slots: DataFrame, entities: DataFrame, validity: DataFrame, slot: str, entity: str) -> DataFrame:
    """Every proven slot for every entity, with validity and a reason where it is missing.

    The full table is the result by definition.
    """
    v = validity.select(slot, entity, "valid_trials")
    grid = every_pair(slots, entities.select(entity).distinct()).join(v, [slot, entity], "left")
    n = F.coalesce("valid_trials", F.lit(0))
    return grid.withColumn("valid_trials", n).withColumn("eligible", n > 0).withColumn("reason", F.when(n == 0, "NO_VALID_TRIAL")) \
        .withColumn("record_id", F.concat_ws("|", F.col(entity).cast("string"), F.col(slot).cast("string")))


def common_rows(tables: dict[str, DataFrame], row: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(rows every table has, retention per table and group)."""
    common = None
    for df in tables.values():
        ids = df.select(row).distinct()
        common = ids if common is None else common.intersect(ids)
    common = durable(common)
    out = None
    for name, df in tables.items():
        marked = df.select(row, group).distinct().join(common.withColumn("_c", F.lit(1)), row, "left")
        r = marked.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count("_c").alias("kept")).select(F.lit(name).alias("source"), group, "rows", "kept", (F.col("kept") / F.col("rows")).alias("retention"))
        out = r if out is None else out.unionByName(r)
    return common, out

