"""Fold rules against the plain greedy loop, invariants, and freedom from input order."""

import random

import pytest
from pyspark.sql import functions as F

from heldout.operators import splits
from heldout.operators.audit import crossing
from heldout.operators.digests import table_digest
from heldout.operators.splits import _fill_plan


def greedy(sizes, k):
    totals, out = [0] * k, []
    for s in sizes:
        f = min(range(k), key=lambda i: (totals[i], i))
        out.append(f)
        totals[f] += s
    return out


def test_fill_plan_equals_greedy():
    rng = random.Random(7)
    for _ in range(400):
        k = rng.randint(1, 6)
        sizes = sorted((rng.choice([1, 1, 1, 2, 3, 5, 9, 20]) for _ in range(rng.randint(1, 40))), reverse=True)
        hist = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
        got = []
        for (size, segments), (_, count) in zip(_fill_plan(hist, k), hist):
            for i in range(count):
                start, cycle = [s for s in segments if s[0] <= i][-1]
                got.append(cycle[(i - start) % len(cycle)])
        assert got == greedy(sizes, k)


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(5)
    rows = []
    for s in range(24):
        for m in range(60):
            if rng.random() < 0.7:
                rows.append((f"{s}|{m}", f"s{s:02d}", f"m{m:02d}", f"g{m // 3:02d}", rng.randint(1, 5), "AMBIGUOUS" if m == 7 and s % 5 == 2 else "VERIFIED", rng.random() < 0.97))
    return spark.createDataFrame(rows, "record_id string, subject_id string, stimulus_id string, group_key string, trials long, join_status string, eligible boolean")


def test_split_is_leak_free(spark, records):
    s = splits.joint_split(records, seed=1, dataset="d", task="t")
    assert all(r["violations"] == 0 for r in splits.split_violations(s["subjects"], s["groups"], s["assigned"], 6, 5).collect())
    roles = splits.cell_roles(s["assigned"], 6, 5)
    for column in ("subject_id", "stimulus_id", "group_key"):
        assert crossing(roles, ["cell_subject", "cell_text"], column).isEmpty()
    assert s["excluded"].filter("stimulus_id = 'm07'").count() == records.filter("stimulus_id = 'm07'").count()
    assert s["excluded"].count() + s["eligible"].count() == records.count()


def test_order_free(spark, records):
    a = table_digest(splits.joint_split(records, seed=1, dataset="d", task="t")["assigned"]).first()
    b = table_digest(splits.joint_split(records.orderBy(F.col("record_id").desc()).repartition(3), seed=1, dataset="d", task="t")["assigned"]).first()
    assert a["table_digest"] == b["table_digest"]


def test_inner_split(spark, records):
    a = splits.joint_split(records, seed=1, dataset="d", task="t")["assigned"]
    obs = a.select("record_id", F.col("stimulus_id").alias("item_id"), F.col("trials").alias("n"))
    i = splits.inner_split(a, obs, seed=1, task="t")
    assert i["k"] in (3, 4)
    counts = splits.inner_cell_counts(a, i, i["k"]).collect()
    outer = {(r["cell_subject"], r["cell_text"]): r["train_records"] for r in splits.cell_counts(a, 6, 5).collect()}
    assert len(counts) == 30 * i["k"] ** 2
    for r in counts:
        assert r["train_records"] + r["validation_records"] + r["held_out_only_records"] == outer[(r["cell_subject"], r["cell_text"])]


def test_fill_plan_stays_short():
    """One group that dwarfs the rest takes a few segments, not a place for every small group."""
    assert all(len(segments) <= 5 for _, segments in _fill_plan([(200_000, 1), (1, 900_000)], 5))


def test_inner_crossings_without_copies(spark, records):
    """Counts of inner cells equal those of the copied role table, spoiled folds are found, and no record is copied per inner cell."""
    a = splits.joint_split(records, seed=1, dataset="d", task="t")["assigned"].localCheckpoint()
    i = splits.inner_assignments(a, seed=1, task="t", k=3)
    subjects, groups = i["subjects"].localCheckpoint(), i["groups"].localCheckpoint()
    # one group is dealt to another inner fold than its stimulus's second half, which moves under another group
    spoiled = a.withColumn("group_key", F.when((F.col("stimulus_id") == "m10") & (F.col("trials") > 2), "g05").otherwise(F.col("group_key")))
    folds = {"subjects": subjects, "groups": groups}
    cells = ["cell_subject", "cell_text"]
    for df in (a, spoiled):
        copied = splits.cell_roles(df, 6, 5).filter("role = 'train'").drop("role").join(subjects.select(*cells, "subject_id", "inner_subject_fold"), [*cells, "subject_id"])
        copied = copied.join(groups.select(*cells, "group_key", "inner_text_fold"), [*cells, "group_key"])
        roles = splits.cell_roles(copied, 3, 3, "inner_subject_fold", "inner_text_fold", "inner_s", "inner_t", "validation")
        for member in ("subject_id", "stimulus_id"):
            want = crossing(roles, [*cells, "inner_s", "inner_t"], member, "train", "validation").groupBy(member).count()
            got = splits.inner_crossings(df, folds, member, 3)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert splits.inner_crossings(spoiled, folds, "stimulus_id", 3).count() == 1


def test_cell_role_totals_equal_the_role_table(spark, records):
    a = splits.joint_split(records, seed=1, dataset="d", task="t")["assigned"].localCheckpoint()
    want = splits.cell_roles(a, 6, 5).groupBy("cell_subject", "cell_text", "role").agg(
        F.count_distinct("subject_id"), F.count_distinct("stimulus_id"), F.sum("trials"))
    got = splits.cell_role_totals(a, 6, 5, {"subjects": "subject_id", "stimuli": "stimulus_id"}, "trials")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
