"""A sound ledger has no fault; every single mutation has exactly its own."""

import copy

import pytest

from heldout.operators import run_ledger
from heldout.operators.run_ledger import validate_run_ledger

HASHES = {"split": "a1", "protocol": "b2"}
OUTER = [("o1", f"r{i}", "train" if i < 6 else "test") for i in range(8)] + [("o2", f"r{i}", "test" if i < 2 else "train") for i in range(8)]
INNER = [("o1", "i1", f"r{i}", "train" if i < 4 else "validation") for i in range(6)] + [("o2", "i2", f"r{i}", "train") for i in range(2, 8)]
SOUND = {
    "version": 1, "dataset": "d", "inputs": HASHES,
    "stages": [
        dict(type="model_fit", outer="o1", inner="i1", inputs=HASHES, fit=["r0", "r1"], selection=["r4", "r5"]),
        dict(type="probe_fit", outer="o1", inner=None, inputs=HASHES, fit=["r4", "r5"]),
        dict(type="final_scoring", outer="o1", inner=None, inputs=HASHES, outer_test_read=["r6", "r7"]),
    ],
}


def change(path, value):
    def make():
        x = copy.deepcopy(SOUND)
        at = x
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
        return x

    return make


CASES = {
    "sound": (lambda: SOUND, set()),
    "version": (change(["version"], 2), {(None, "SCHEMA_OR_DATASET_MISMATCH")}), "dataset": (change(["dataset"], None), {(None, "SCHEMA_OR_DATASET_MISMATCH")}),
    "no hashes": (change(["inputs"], None), {(None, "RUN_INPUT_HASHES_MISSING")}), "other hash": (change(["inputs"], {"split": "a1", "protocol": "x"}), {(None, "RUN_INPUT_HASHES_DIFFER")}),
    "one hash more": (change(["stages", 0, "inputs"], {**HASHES, "more": "c"}), {(0, "STAGE_INPUT_HASHES_DIFFER")}), "stage without hashes": (change(["stages", 1, "inputs"], None), {(1, "STAGE_INPUT_HASHES_MISSING")}),
    "no stages": (change(["stages"], []), {(None, "NO_STAGES")}), "stage type": (change(["stages", 1, "type"], "guess"), {(1, "UNKNOWN_STAGE_TYPE")}),
    "outer cell": (change(["stages", 0, "outer"], "o9"), {(0, "UNKNOWN_OUTER_CELL")}),
    "wrong parent": (change(["stages", 1, "inner"], "i2"), {(1, "UNKNOWN_OR_WRONG_PARENT_INNER_CELL")}),
    "repeated": (change(["stages", 0, "fit"], ["r0", "r0"]), {(0, "REPEATED_ID")}), "empty id": (change(["stages", 0, "fit"], ["r0", ""]), {(0, "EMPTY_ID"), (0, "FIT_OUTSIDE_TRAIN")}),
    "fit outside": (change(["stages", 0, "fit"], ["r0", "r9"]), {(0, "FIT_OUTSIDE_TRAIN")}), "selection outside": (change(["stages", 0, "selection"], ["r3"]), {(0, "SELECTION_OUTSIDE_INNER_VALIDATION")}),
    "mixing": (change(["stages", 0, "fit"], ["r0", "r4"]), {(0, "FIT_OUTSIDE_TRAIN"), (0, "INNER_VALIDATION_ENTERS_FIT")}),
    "test in fit": (change(["stages", 1, "fit"], ["r6"]), {(1, "FIT_OUTSIDE_TRAIN"), (1, "OUTER_TEST_IN_FIT_OR_SELECTION")}),
    "calibration": (change(["stages", 2, "calibration"], ["r6"]), {(2, "TEST_TIME_CALIBRATION")}), "scoring fits": (change(["stages", 2, "fit"], ["r0"]), {(2, "FINAL_SCORING_FITS_OR_SELECTS")}),
    "scoring reads": (change(["stages", 2, "outer_test_read"], ["r0"]), {(2, "FINAL_SCORING_READS_NON_TEST")}), "early": (change(["stages", 1, "outer_test_read"], ["r6"]), {(1, "OUTER_TEST_READ_EARLY")}),
}


@pytest.fixture(scope="module")
def found(spark):
    """All cases are runs of one table."""
    runs, stages, ids = [], [], []
    for name, (make, _) in CASES.items():
        x = make()
        runs.append((name, x["version"], x["dataset"], x["inputs"]))
        for k, s in enumerate(x["stages"]):
            stages.append((name, k, s["type"], s["outer"], s["inner"], s["inputs"]))
            ids += [(name, k, kind, i) for kind in ("fit", "selection", "outer_test_read", "calibration") for i in s.get(kind, [])]
    out = validate_run_ledger(
        spark.createDataFrame(runs, "run_id string, schema_version int, dataset string, inputs map<string,string>"),
        spark.createDataFrame(stages, "run_id string, stage long, stage_type string, outer_cell string, inner_cell string, inputs map<string,string>"),
        spark.createDataFrame(ids, "run_id string, stage long, kind string, record_id string"),
        spark.createDataFrame(OUTER, "outer_cell string, record_id string, role string"), spark.createDataFrame(INNER, "outer_cell string, inner_cell string, record_id string, role string"), HASHES, 1, "d")
    got = {}
    for r in out.collect():
        got.setdefault(r.run_id, set()).add((r.stage, r.error))
    return got


@pytest.mark.parametrize("name", CASES)
def test_mutation(found, name):
    assert found.get(name, set()) == CASES[name][1]


def test_ids_of_a_stage_are_not_brought_together(spark):
    """Stages are broadcast: no exchange of the ids is dealt by run and stage alone, however large the roles are."""
    ids = spark.range(100).selectExpr("'a' run_id", "0L stage", "'fit' kind", "cast(id as string) record_id")
    roles = ids.selectExpr("'o' outer_cell", "record_id", "'test' role")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, small_ = [], run_ledger.durable
    try:
        run_ledger.durable = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or small_(df)
        out = validate_run_ledger(
            spark.createDataFrame([("a", 1, "d", HASHES)], "run_id string, schema_version int, dataset string, inputs map<string,string>"),
            spark.createDataFrame([("a", 0, "model_fit", "o", None, HASHES)], "run_id string, stage long, stage_type string, outer_cell string, inner_cell string, inputs map<string,string>"),
            ids, roles, roles.selectExpr("outer_cell", "'i' inner_cell", "record_id", "role"), HASHES, 1, "d")
        got = {(r.error, r.records) for r in out.collect()}
    finally:
        run_ledger.durable = small_
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {("FIT_OUTSIDE_TRAIN", 100), ("OUTER_TEST_IN_FIT_OR_SELECTION", 100)}
    assert plans and all("SortMergeJoin [run_id" not in p for p in plans)
