"""Matched null controls: seeded permutations without fixed points, closed in their scope."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..functions.vectors import inject, permute_blocks
from .durable import durable
from .ranking import positions


def cycle_donors(df: DataFrame, within: list[str], unit: str, seed, arm: str, payload: dict[str, str]) -> DataFrame:
    """One cycle through each group in hash order: the donor is the next unit, the last takes the first.

    Groups with a single unit have no donor; their payload columns stay NULL
    and ``reason`` says so.
    """
    keyed = df.withColumn("_h", sha256(F.lit(seed), F.lit(arm), *within, unit))
    n = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    ranked = durable(positions(keyed, within, ["_h", unit], "_p").drop("_h"))
    donors = ranked.select(*within, "_p", *[F.col(c).alias(o) for c, o in payload.items()])
    wanted = ranked.join(n, within).withColumn("_q", (F.col("_p") + 1) % F.col("_n"))
    joined = wanted.join(donors.withColumnRenamed("_p", "_q"), [*within, "_q"])
    out = joined.select(
        *df.columns,
        *[F.when(F.col("_n") > 1, F.col(o)).alias(o) for o in payload.values()],
        F.when(F.col("_n") < 2, "FEWER_THAN_TWO_UNITS").alias("reason"),
    )
    return out


def block_cycle(blocks: int, *parts) -> Column:
    """A one-cycle permutation of block numbers in hash order of (parts, block), as an array."""
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)),
            lambda j: F.struct(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts], j.cast("string")), 256).alias("h"), j.alias("j")),
        )
    )
    plain = F.transform(order, lambda s: s["j"])
    return F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda j: F.element_at(plain, (F.array_position(plain, j) % blocks + 1).cast("int")),
    )


def block_permutation(df: DataFrame, vector: str, blocks: int, width: int, seed, record: str, out: str) -> DataFrame:
    """Whole blocks of a vector moved along one cycle per record."""
    perm = block_cycle(blocks, F.lit(seed), F.lit("channel_block_permutation"), F.col(record))
    return df.withColumn("_perm", perm).withColumn(out, permute_blocks(F.col(vector), F.col("_perm"), width)).drop("_perm")


def resample_position(position: Column, own: Column, donor: Column) -> Column:
    """Donor position for a target position when the two sequences differ in length; half goes to even."""
    return F.when(own <= 1, F.lit(0)).otherwise(F.rint(position * (donor - 1) / (own - 1)).cast("long")).cast("long")


def _flow(classes: list[tuple[str, int, int]]) -> tuple[list[bool], dict[tuple[int, int], int] | None]:
    """(which classes have a legal donor, class-to-class counts of a perfect assignment or None).

    ``classes`` are (group, units, count) sorted by units, so the legal donors
    of a class are one stretch of the list without its own group.
    """
    n = len(classes)
    units = [c[1] for c in classes]
    band = [(bisect_left(units, -(-3 * u // 4)), bisect_right(units, 5 * u // 4)) for u in units]
    active = [True] * n
    changed = True
    while changed:
        changed = False
        for i in range(n):
            if active[i] and not any(active[j] and classes[j][0] != classes[i][0] for j in range(*band[i])):
                active[i], changed = False, True
    need = [c[2] if active[i] else 0 for i, c in enumerate(classes)]
    free = list(need)
    flow: dict[tuple[int, int], int] = {}
    givers: list[set[int]] = [set() for _ in range(n)]

    def send(i, j, amount):
        flow[(i, j)] = flow.get((i, j), 0) + amount
        givers[j].add(i)
        if not flow[(i, j)]:
            del flow[(i, j)]
            givers[j].discard(i)

    for start in range(n):
        while need[start]:
            came: dict[tuple[str, int], int] = {}
            queue, seen, end = deque([start]), {start}, None
            fresh = list(range(n + 1))  # next donor class not reached yet

            def reach(j):
                while fresh[j] != j:
                    fresh[j] = fresh[fresh[j]]
                    j = fresh[j]
                return j

            while queue and end is None:
                i = queue.popleft()
                j = reach(band[i][0])
                while j < band[i][1]:
                    if active[j] and classes[j][0] != classes[i][0]:
                        fresh[j] = j + 1
                        came[("d", j)] = i
                        if free[j]:
                            end = j
                            break
                        for k in givers[j] - seen:
                            seen.add(k)
                            came[("t", k)] = j
                            queue.append(k)
                    j = reach(j + 1)
            if end is None:
                return active, None
            steps, j = [], end
            while True:
                i = came[("d", j)]
                steps.append((i, j))
                if i == start:
                    break
                j = came[("t", i)]
            amount = min([need[start], free[end]] + [flow[(i, came[("t", i)])] for i, _ in steps if i != start])
            for i, j in steps:
                send(i, j, amount)
                if i != start:
                    send(i, came[("t", i)], -amount)
            need[start] -= amount
            free[end] -= amount
    return active, flow


def match_donors(trials: DataFrame, bucket: list[str], record: str, group: str, units: str, seed) -> DataFrame:
    """One donor per record, a permutation of the bucket's records, or a reason why not.

    Legal: other group, unit counts within 0.75 to 1.25. Records with the same
    (group, unit count) are interchangeable, so only the counts of those
    classes meet in one task; the records pair up by hash rank in a join.
    A bucket without a perfect assignment is excluded whole.
    """
    base = trials.select(*bucket, record, group, F.col(units).cast("long").alias("_u")).withColumn(
        "_h", sha256(F.lit(seed), F.lit("trial_shuffle"), record))
    counts = base.groupBy(*bucket, group, "_u").agg(F.count(F.lit(1)).alias("_n"))
    schema = trials.select(*bucket, group).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    gtype = schema[group].dataType.simpleString()

    def solve(head, rows):
        active, flow = _flow(rows)
        out = []
        t_at, d_at = [0] * len(rows), [0] * len(rows)
        for i, (g, u, n) in enumerate(rows):
            if not active[i]:
                out.append([*head, g, u, 0, n, None, None, None, "TRIAL_SHUFFLE_NO_LEGAL_DONOR"])
            elif flow is None:
                out.append([*head, g, u, 0, n, None, None, None, "TRIAL_SHUFFLE_DERANGEMENT_UNAVAILABLE"])
        for (i, j), n in sorted((flow or {}).items()):
            out.append([*head, rows[i][0], rows[i][1], t_at[i], n, rows[j][0], rows[j][1], d_at[j] - t_at[i], None])
            t_at[i] += n
            d_at[j] += n
        return out

    def runs(batches):
        """Buckets follow each other in sorted batches; one bucket's classes are held at a time."""
        columns = [*bucket, group, "_u", "_from", "_len", "_dg", "_du", "_shift", "reason"]
        head, rows, out = None, [], []
        for pdf in batches:
            for *b, g, u, n in zip(*[pdf[c] for c in [*bucket, group, "_u", "_n"]]):
                if b != head:
                    if rows:
                        out += solve(head, rows)
                    head, rows = b, []
                rows.append((g, int(u), int(n)))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns).convert_dtypes()
                out = []
        if rows:
            out += solve(head, rows)
        if out:
            yield pd.DataFrame(out, columns=columns).convert_dtypes()

    ordered = counts.repartition(*bucket).sortWithinPartitions(*bucket, "_u", group)
    plan = ordered.mapInPandas(runs, f"{fields}, _u long, _from long, _len long, _dg {gtype}, _du long, _shift long, reason string")
    ranked = durable(positions(base, [*bucket, group, "_u"], ["_h", record], "_p"))
    targets = ranked.join(plan, [*bucket, group, "_u"]).filter(
        (F.col("_p") >= F.col("_from")) & (F.col("_p") < F.col("_from") + F.col("_len"))
    ).withColumn("_dp", F.col("_p") + F.col("_shift"))
    donors = ranked.select(*bucket, F.col(group).alias("_dg"), F.col("_u").alias("_du"), F.col("_p").alias("_dp"),
                           F.col(record).alias("donor_id"))
    return targets.join(donors, [*bucket, "_dg", "_du", "_dp"], "left").select(
        *bucket, record, group, F.col("_u").alias(units), "donor_id",
        F.col("_dg").alias("donor_group"), F.col("_du").alias("donor_units"), "reason")


def stack_arms(df: DataFrame, keep: list[str], arms: dict[str, str]) -> DataFrame:
    """Rows that have every arm, once per arm: the common support in long form."""
    common = df.dropna(subset=list(arms.values()))
    pairs = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).alias("x")) for a, c in arms.items()])
    return common.select(*keep, F.explode(pairs).alias("_a")).select(*keep, F.col("_a.arm").alias("arm"), F.col("_a.x").alias("x"))


def graded_injection(df: DataFrame, vector: str, code: str, levels: list[float], out: str = "injected") -> DataFrame:
    """Every row once per level with ``vector + level * code``."""
    level = F.explode(F.array(*[F.lit(float(v)) for v in levels]))
    return df.withColumn("level", level).withColumn(out, inject(F.col(vector), F.col(code), F.col("level")))
