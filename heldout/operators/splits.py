"""Two-way entity x material splits, nested splits and their proofs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..functions.parsing import reasons
from .durable import durable
from .ranking import exact_quantiles, positions

# Join states that count as verified.
ACCEPTED_STATES = ["APPROVED", "PROVEN", "SOURCE_VERIFIED", "VERIFIED"]


def exclusion_reasons(records: DataFrame) -> DataFrame:
    """Adds ``reasons``: row faults plus faults of the whole stimulus, sorted."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    unverified = ~F.coalesce(F.upper(F.trim("join_status")), F.lit("UNVERIFIED")).isin(ACCEPTED_STATES)
    per_stimulus = (
        records.filter(~blank("stimulus_id"))
        .groupBy("stimulus_id")
        .agg(
            F.bool_or(unverified).alias("_any_unverified"),
            (F.min(F.when(~blank("group_key"), F.col("group_key")))
             != F.max(F.when(~blank("group_key"), F.col("group_key")))).alias("_conflict"),
        )
    )
    joined = records.join(per_stimulus, "stimulus_id", "left")
    fixed = reasons(
        (blank("subject_id"), "MISSING_SUBJECT_ID"),
        (blank("stimulus_id"), "MISSING_STIMULUS_ID"),
        (blank("group_key"), "MISSING_GROUP_KEY"),
        (F.coalesce(F.col("trials"), F.lit(0)) <= 0, "NONPOSITIVE_OR_INVALID_VALID_SENTENCE_TRIALS"),
        (~F.col("eligible"), "EXPLICITLY_EXCLUDED"),
        (unverified, "MATERIAL_JOIN_NOT_VERIFIED"),
        (F.coalesce("_conflict", F.lit(False)), "STIMULUS_GROUP_IDENTITY_CONFLICT"),
        (F.coalesce("_any_unverified", F.lit(False)), "STIMULUS_HAS_UNVERIFIED_JOIN"),
    )
    return joined.withColumn("reasons", fixed).drop("_any_unverified", "_conflict")


def round_robin_folds(weights: DataFrame, entity: str, weight: str, k, within=(), out="fold") -> DataFrame:
    """Deal entities to ``k`` folds in order of (weight descending, id)."""
    ranked = positions(weights, list(within), [F.col(weight).desc(), F.col(entity)], "_p")
    return ranked.withColumn(out, (F.col("_p") % k).cast("int")).drop("_p")


def _fill_plan(histogram, k: int):
    """For each size, largest first: segments (first position, cycle of folds) that its groups go through.

    A group of size c takes the least loaded fold, so the choices are the
    smallest pairs (total + i*c, fold). Writing a total as q*c + r, the pairs of
    one level q + i come in order of (r, fold), and a fold joins at its own q:
    at most k segments tell all places, however many groups there are.
    """
    totals = [0] * k
    for size, count in histogram:
        level = {f: divmod(totals[f], size) for f in range(k)}
        steps = sorted({q for q, _ in level.values()})
        segments, at, now = [], 0, list(totals)
        for low, high in zip(steps, [*steps[1:], None], strict=True):
            cycle = sorted((f for f in range(k) if level[f][0] <= low), key=lambda f: (level[f][1], f))
            here = count - at if high is None else min(count - at, (high - low) * len(cycle))
            if here <= 0:
                break
            segments.append((at, cycle))
            for place, f in enumerate(cycle):
                now[f] += size * (here // len(cycle) + (1 if place < here % len(cycle) else 0))
            at += here
        yield size, segments
        totals = now


def balanced_group_folds(groups: DataFrame, group: str, size: str, digest: str, k: int, within=(), out="fold") -> DataFrame:
    """Largest groups first (hash, then key, on ties), each to the least loaded fold.

    Only the histogram of group sizes visits the driver, and at most ``k`` segments per size go back.
    """
    within = list(within)
    spark = groups.sparkSession
    histogram = groups.groupBy(*within, size).agg(F.count(F.lit(1)).alias("n")).collect()
    by_cell: dict[tuple, list[tuple[int, int]]] = {}
    for r in histogram:
        by_cell.setdefault(tuple(r[w] for w in within), []).append((int(r[size]), int(r["n"])))
    plan = [
        (*cell, *step)
        for cell, sizes in by_cell.items()
        for step in _fill_plan(sorted(sizes, reverse=True), k)
    ]
    fields = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*within, size).schema.fields
    )
    steps = spark.createDataFrame(plan, f"{fields}, _segments array<struct<start:long,cycle:array<int>>>")
    if len(plan) <= 100_000:  # of k segments at most
        steps = F.broadcast(steps)
    ranked = positions(groups, [*within, size], [digest, group], "_p")
    segment = F.element_at(F.filter("_segments", lambda s: s["start"] <= F.col("_p")), -1)
    place = (F.col("_p") - segment["start"]) % F.size(segment["cycle"])
    fold = F.element_at(segment["cycle"], (place + 1).cast("int"))
    return ranked.join(steps, [*within, size]).withColumn(out, fold).drop("_p", "_segments")


def entity_folds(records: DataFrame, k: int) -> DataFrame:
    weights = records.groupBy("subject_id").agg(F.sum("trials").alias("trials"))
    return round_robin_folds(weights, "subject_id", "trials", k, out="subject_fold")


def material_folds(records: DataFrame, k: int, seed: int, dataset: str, task: str) -> DataFrame:
    sizes = (
        records.select("group_key", "stimulus_id").distinct()
        .groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
        .withColumn("group_hash", sha256(F.lit(seed), F.lit(dataset), F.lit(task), "group_key"))
    )
    return balanced_group_folds(sizes, "group_key", "size", "group_hash", k, out="text_fold")


class Parts(dict):
    """Named tables that are made, with all they write, when they are first asked for."""

    def __init__(self, **makers):
        super().__init__()
        self._makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._makers[name]()
        return self[name]


def joint_split(records: DataFrame, *, seed: int, dataset: str, task: str, ks: int = 6, kt: int = 5) -> Parts:
    """Ledger (``excluded``), folds (``subjects``, ``groups``) and the ``eligible`` records, ``assigned`` with both fold numbers.

    Roles are a predicate on the two numbers, so no cell x record table is
    needed. Each part is evaluated when asked for; the ledger needs no folds.
    """
    parts = Parts(
        # read by all other parts; writing it spares as many evaluations of the source
        marked=lambda: durable(exclusion_reasons(records)),
        excluded=lambda: parts["marked"].filter(F.size("reasons") > 0),
        eligible=lambda: parts["marked"].filter(F.size("reasons") == 0).drop("reasons"),
        subjects=lambda: durable(entity_folds(parts["eligible"], ks)),
        groups=lambda: durable(material_folds(parts["eligible"], kt, seed, dataset, task)),
        assigned=lambda: parts["eligible"].join(parts["subjects"].select("subject_id", "subject_fold"), "subject_id").join(parts["groups"].select("group_key", "text_fold"), "group_key"),
    )
    return parts


def cell_roles(df: DataFrame, ks: int, kt: int, sf="subject_fold", tf="text_fold", cs="cell_subject", ct="cell_text", inside="test") -> DataFrame:
    """Every row once per cell of the ks x kt grid with its role; both counts are parameters."""
    s = F.explode(F.sequence(F.lit(0), F.lit(ks - 1)))
    t = F.explode(F.sequence(F.lit(0), F.lit(kt - 1)))
    grid = df.select("*", s.alias(cs)).select("*", t.alias(ct))
    role = (
        F.when((F.col(sf) == F.col(cs)) & (F.col(tf) == F.col(ct)), inside)
        .when((F.col(sf) != F.col(cs)) & (F.col(tf) != F.col(ct)), "train")
        .otherwise("held_out_only")
    )
    return grid.withColumn("role", role)


#: A letter for each role, so that a string tells a row's role in every cell.
MARKS = {"r": "train", "v": "validation", "t": "test", "-": "held_out_only"}


def cell_marks(ks: int, kt: int, sf="subject_fold", tf="text_fold") -> Column:
    """The roles of ``cell_roles`` as one letter per cell (see ``MARKS``), cell (s, t) at place s * kt + t; no row is copied.

    Folds are NULL or within the grid; each pair's letters are looked up in a constant.
    """
    cells = [(s, t) for s in range(ks) for t in range(kt)]
    rows = ["".join("t" if (s, t) == (u, v) else "r" if s != u and t != v else "-" for u, v in cells) for s, t in cells]
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in rows]), F.col(sf) * kt + F.col(tf)), F.lit("-" * len(cells)))


def marked_cells(df: DataFrame, marks: str, kt: int, cs="cell_subject", ct="cell_text") -> DataFrame:
    """Every row once per cell with its role, told from the letters; made for rows that stand for many."""
    other = [c for c in df.columns if c != marks]
    each = df.select(*other, F.posexplode(F.split(marks, "")).alias("_at", "_m")).filter("_m <> ''")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), F.col("_m"))
    return each.select(*other, F.expr(f"cast(_at div {int(kt)} as int)").alias(cs), F.expr(f"cast(_at % {int(kt)} as int)").alias(ct), role.alias("role"))


def cell_role_totals(assigned: DataFrame, ks: int, kt: int, members: dict[str, str], value: str) -> DataFrame:
    """Per cell and role: distinct members of each kind (``members`` maps a result name to its column) and the sum of ``value``.

    A member's distinct fold pairs, at most ks x kt, tell its roles in every cell. Members
    with the same pairs are counted first, so no record is copied per cell.
    """
    keys = ["cell_subject", "cell_text", "role"]
    sums = assigned.groupBy("subject_fold", "text_fold").agg(F.sum(value).alias("_v"))
    out = cell_roles(sums, ks, kt).groupBy(*keys).agg(F.sum("_v").alias(value))
    for name, column in members.items():
        pair = F.struct("subject_fold", "text_fold")
        pairs = assigned.filter(F.col(column).isNotNull()).groupBy(column).agg(F.array_sort(F.collect_set(pair)).alias("_p"))
        alike = pairs.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        each = alike.select("_p", "_n", F.explode("_p").alias("_q")).select("_p", "_n", "_q.*")
        found = cell_roles(each, ks, kt).select(*keys, "_p", "_n").distinct()
        out = out.join(found.groupBy(*keys).agg(F.sum("_n").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(*keys, *members, value)


def cell_counts(assigned: DataFrame, ks: int, kt: int) -> DataFrame:
    """Records per cell and role, from the ks x kt fold histogram instead of the records."""
    hist = assigned.groupBy("subject_fold", "text_fold").agg(F.count(F.lit(1)).alias("n"))
    part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"{r}_records")
    return cell_roles(hist, ks, kt).groupBy("cell_subject", "cell_text").agg(
        part("test"), part("train"), part("held_out_only")
    )


def split_violations(subjects: DataFrame, groups: DataFrame, assigned: DataFrame, ks: int, kt: int) -> DataFrame:
    """One row per rule with the number of violations; a sound split has zeros only."""
    spark = assigned.sparkSession

    def count(df, rule):
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    def several(df, k, v):
        return df.groupBy(k).agg(F.min(v).alias("a"), F.max(v).alias("b")).filter("a <> b")

    expected_s = spark.range(ks).select(F.col("id").cast("int").alias("f"))
    expected_t = spark.range(kt).select(F.col("id").cast("int").alias("f"))
    parts = [
        count(several(assigned, "subject_id", "subject_fold"), "each_subject_has_one_fold"),
        count(several(assigned, "stimulus_id", "text_fold"), "each_stimulus_has_one_fold"),
        count(several(assigned, "group_key", "text_fold"), "group_does_not_cross_text_folds"),
        count(expected_s.join(subjects, expected_s.f == subjects.subject_fold, "left_anti"), "all_subject_folds_populated"),
        count(expected_t.join(groups, expected_t.f == groups.text_fold, "left_anti"), "all_text_folds_populated"),
        count(assigned.filter(F.col("subject_fold").isNull() | F.col("text_fold").isNull()), "all_eligible_records_assigned"),
        count(assigned.groupBy("record_id").count().filter("count > 1"), "record_assigned_once"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _outer_train(df: DataFrame, ks: int, kt: int) -> DataFrame:
    """Rows of every outer cell's train part; needs subject_fold and text_fold."""
    return cell_roles(df, ks, kt).filter("role = 'train'").drop("role")


CELL = ["cell_subject", "cell_text"]


def inner_assignments(assigned: DataFrame, *, seed: int, task: str, k: int, ks: int = 6, kt: int = 5) -> dict[str, DataFrame]:
    """Entity and group folds nested in the train part of every outer cell, all cells in one job."""
    per_subject = assigned.groupBy("subject_id", "subject_fold", "text_fold").agg(F.sum("trials").alias("trials"))
    weights = _outer_train(per_subject, ks, kt).groupBy(*CELL, "subject_id").agg(F.sum("trials").alias("trials"))
    subjects = round_robin_folds(weights, "subject_id", "trials", k, CELL, "inner_subject_fold")
    # a stimulus is in a cell's train part if its text fold differs and some record's subject fold differs;
    # stimuli of a group with the same folds (at most ks values) are counted before the grid is made
    stimuli = assigned.groupBy("group_key", "stimulus_id", "text_fold").agg(F.array_sort(F.collect_set("subject_fold")).alias("folds"))
    alike = stimuli.groupBy("group_key", "text_fold", "folds").agg(F.count(F.lit(1)).alias("n"))
    grid = alike.select("*", F.explode(F.sequence(F.lit(0), F.lit(ks - 1))).alias("cell_subject")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(kt - 1))).alias("cell_text")
    )
    present = grid.filter(
        (F.col("text_fold") != F.col("cell_text"))
        & F.exists("folds", lambda f: f != F.col("cell_subject"))
    )
    cell_id = F.concat(F.lit(f"{task}|outer_s"), "cell_subject", F.lit("_t"), "cell_text")
    sizes = (
        present.groupBy(*CELL, "group_key").agg(F.sum("n").alias("size"))
        .withColumn("group_hash", sha256(F.lit(seed), cell_id, F.lit("inner"), "group_key"))
    )
    groups = balanced_group_folds(sizes, "group_key", "size", "group_hash", k, CELL, "inner_text_fold")
    return {"subjects": subjects, "groups": groups}


def _cell_folds(folds: DataFrame, member: str, fold: str, ks: int, kt: int, out: str) -> DataFrame:
    """One row per member: its inner fold in each of the ks x kt outer cells in order, NULL where it has none."""
    number = F.col("cell_subject") * kt + F.col("cell_text")
    known = folds.groupBy(member).agg(F.map_from_entries(F.collect_list(F.struct(number, F.col(fold)))).alias("_m"))  # at most one entry a cell
    return known.select(member, F.array(*[F.try_element_at("_m", F.lit(c)) for c in range(ks * kt)]).alias(out))


def _inner_places(pre: DataFrame, inner: dict[str, DataFrame], k: int, ks: int, kt: int) -> DataFrame:
    """Rows of ``pre`` with ``places``: per outer cell, in order, the row's inner place (entity fold x k + group fold), or -1 outside its train part.

    Each row is joined once to its entity and once to its group; no row is copied per cell.
    """
    s = _cell_folds(inner["subjects"], "subject_id", "inner_subject_fold", ks, kt, "_s")
    g = _cell_folds(inner["groups"], "group_key", "inner_text_fold", ks, kt, "_g")
    place = lambda a, b: F.when(
        (F.col("subject_fold") != a) & (F.col("text_fold") != b),
        F.col("_s")[a * kt + b] * k + F.col("_g")[a * kt + b])
    places = F.array(*[F.coalesce(place(a, b), F.lit(-1)) for a in range(ks) for b in range(kt)])
    return pre.join(s, "subject_id").join(g, "group_key").withColumn("places", places).drop("_s", "_g")


def _inner_counts(pre: DataFrame, inner: dict[str, DataFrame], k: int, ks: int, kt: int, keep=()) -> DataFrame:
    """Sum of ``n`` per outer cell, pair of inner folds and ``keep``; the copies per cell are summed where they are made."""
    rows = _inner_places(pre, inner, k, ks, kt).select(*keep, "n", F.posexplode("places").alias("_c", "_p")).filter("_p >= 0")
    sums = rows.groupBy("_c", "_p", *keep).agg(F.sum("n").alias("n"))
    whole = lambda c: F.floor(c).cast("int")
    return sums.select(
        whole(F.col("_c") / kt).alias("cell_subject"), (F.col("_c") % kt).alias("cell_text"),
        whole(F.col("_p") / k).alias("inner_subject_fold"), (F.col("_p") % k).alias("inner_text_fold"), *keep, "n")


def inner_crossings(assigned: DataFrame, inner: dict[str, DataFrame], member: str, k: int, ks: int = 6, kt: int = 5) -> DataFrame:
    """Inner cells of each outer cell in which members have records in train and in validation, as (member, crossings).

    A member crosses inner cell (i, j) if one of its records has exactly these
    inner folds and another one has neither. A bit for each place tells
    which ones a member has: one row per member and a few whole numbers leave a task.
    """
    squares, cells = k * k, ks * kt
    if squares > 62:
        raise ValueError("at most 7 inner folds")
    per = 62 // squares  # outer cells in one number
    rows = _inner_places(assigned, inner, k, ks, kt).select(member, "places")
    bit = lambda c: F.when(F.col("places")[c] >= 0, F.expr(f"shiftleft(1L, places[{c}] + {c % per * squares})")).otherwise(F.lit(0).cast("long"))
    words = [[bit(c) for c in range(w, min(w + per, cells))] for w in range(0, cells, per)]
    held = rows.groupBy(member).agg(*[F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), w)).alias(f"_w{i}") for i, w in enumerate(words)])
    each = held.select(member, F.explode(F.array(*[F.shiftright(f"_w{c // per}", c % per * squares).bitwiseAND((1 << squares) - 1) for c in range(cells)])).alias("_m"))
    away = lambda p: sum(1 << q for q in range(squares) if q // k != p // k and q % k != p % k)
    crossed = [F.when((F.col("_m").bitwiseAND(1 << p) != 0) & (F.col("_m").bitwiseAND(away(p)) != 0), 1).otherwise(0) for p in range(squares)]
    return each.withColumn("_x", reduce(lambda a, b: a + b, crossed)).groupBy(member).agg(F.sum("_x").alias("crossings")).filter("crossings > 0")


def inner_support(assigned: DataFrame, observations: DataFrame, inner, k: int, ks: int = 6, kt: int = 5) -> DataFrame:
    """Median, quartiles and range of item counts over the train part of each inner cell."""
    tagged = observations.join(
        assigned.select("record_id", "subject_id", "group_key", "subject_fold", "text_fold"), "record_id"
    )
    hist = durable(_inner_counts(tagged, inner, k, ks, kt, ["item_id"]))
    roles = cell_roles(hist, k, k, "inner_subject_fold", "inner_text_fold", "inner_s", "inner_t", "validation")
    keys = [*CELL, "inner_s", "inner_t"]
    items = durable(roles.filter("role = 'train'").groupBy(*keys, "item_id").agg(F.sum("n").alias("n")))
    return exact_quantiles(items, keys, "n", {"median": 0.5}).join(
        items.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_count"), F.min("n").alias("min"), F.max("n").alias("max")), keys
    )


def inner_cell_counts(assigned: DataFrame, inner, k: int, ks: int = 6, kt: int = 5) -> DataFrame:
    pre = assigned.groupBy("subject_id", "group_key", "subject_fold", "text_fold").agg(F.count(F.lit(1)).alias("n"))
    hist = _inner_counts(pre, inner, k, ks, kt)
    roles = cell_roles(hist, k, k, "inner_subject_fold", "inner_text_fold", "inner_s", "inner_t", "validation")
    part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"{r}_records")
    return roles.groupBy(*CELL, "inner_s", "inner_t").agg(part("train"), part("validation"), part("held_out_only"))


def downgrade_decision(inner_subjects: DataFrame, support: DataFrame, min_subjects: int = 12, min_median: float = 10.0) -> DataFrame:
    """One row: whether every cell of the task drops to fewer inner folds."""
    s = inner_subjects.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_subjects"))
    m = support.agg(F.min("median").alias("min_median"))
    return s.join(F.broadcast(m)).select(  # one row each
        "min_subjects", "min_median",
        (F.col("min_subjects") < min_subjects).alias("subject_trigger"),
        (F.col("min_median") < min_median).alias("item_trigger"),
        ((F.col("min_subjects") < min_subjects) | (F.col("min_median") < min_median)).alias("downgraded"),
    )


def inner_split(assigned: DataFrame, observations: DataFrame, *, seed: int, task: str, k: int = 4, downgraded_k: int = 3, ks: int = 6, kt: int = 5) -> dict:
    """Nested split with the task-wide choice of the fold count."""
    first = inner_assignments(assigned, seed=seed, task=task, k=k, ks=ks, kt=kt)
    decision = downgrade_decision(first["subjects"], inner_support(assigned, observations, first, k, ks, kt))
    final_k = downgraded_k if decision.first()["downgraded"] else k
    final = first if final_k == k else inner_assignments(assigned, seed=seed, task=task, k=final_k, ks=ks, kt=kt)
    return {**final, "decision": decision, "k": final_k}


def candidate_scopes(assigned: DataFrame, inner_groups: DataFrame) -> DataFrame:
    """Stimulus pools: one per outer text fold, one per (outer cell, inner text fold)."""
    stimuli = assigned.select("group_key", "stimulus_id", "text_fold", "subject_fold").distinct()
    outer = stimuli.select(
        F.lit("outer_test").alias("scope_type"),
        F.concat(F.lit("outer|t"), "text_fold").alias("scope_id"), "stimulus_id",
    ).distinct()
    inner = (
        stimuli.join(inner_groups.select(*CELL, "group_key", "inner_text_fold"), "group_key")
        .filter(F.col("subject_fold") != F.col("cell_subject"))
        .select(
            F.lit("inner_validation").alias("scope_type"),
            F.concat(F.lit("inner|s"), "cell_subject", F.lit("_t"), "cell_text", F.lit("|t"), "inner_text_fold").alias("scope_id"),
            "stimulus_id",
        ).distinct()
    )
    return outer.unionByName(inner)


def recovery_roles(assigned: DataFrame, fold: int, ks: int, kt: int) -> DataFrame:
    """Fit / seen / cross parts: neither held out; text held out only; both held out."""
    s, t = F.col("subject_fold") == fold % ks, F.col("text_fold") == fold % kt
    role = F.when(~s & ~t, "fit").when(~s & t, "seen_entity").when(s & t, "cross_entity").otherwise("unused")
    return assigned.withColumn("part", role)


def hash_halves(df: DataFrame, within: list[str], digest: str, item: str, out: str = "half") -> DataFrame:
    """Halves by hash order inside each split: positions below floor(n/2) are half 0."""
    n = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    ranked = positions(df, within, [digest, item], "_p").join(n, within)
    return ranked.withColumn(out, F.when(F.col("_p") < F.floor(F.col("_n") / 2), 0).otherwise(1)).drop("_p", "_n")


def share_split(df: DataFrame, digest: str, item: str, share: float, out: str = "part") -> DataFrame:
    """Seeded train/test split: the first floor(share * n) rows of one hash order are train."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = positions(df, [], [digest, item], "_p").join(F.broadcast(n))  # one row
    return ranked.withColumn(out, F.when(F.col("_p") < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")).drop("_p", "_n")
