"""Every ledger rule catches its mutation; sequence and slice joins against brute force; sinks and manifests."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from heldout.operators import audit as au
from heldout.operators import decisions as dc
from heldout.operators import digests as dg
from heldout.operators import joins as jn
from heldout.operators import protocol as pr
from heldout.operators import sequences as sq
from heldout.sources import scans, sinks

CELL = ["c"]


@pytest.fixture(scope="module")
def roles(spark):
    rows = [("x", f"r{i}", role) for i, role in enumerate(["train"] * 3 + ["validation"] * 2 + ["test"] * 2 + ["held_out_only"])]
    return spark.createDataFrame(rows, "c string, record_id string, role string")


def errors(spark, roles, extra):
    clean = au.build_ledger(roles, CELL, "record_id", "run")
    row = spark.createDataFrame([("run|x", "x", *extra)], "run_id string, c string, stage_type string, kind string, record_id string")
    return {r["error"] for r in au.validate_ledger(clean.unionByName(row), roles, CELL).collect()}


@pytest.mark.parametrize("extra,error", [
    (("model_fit", "fit", "r7"), "FIT_OUTSIDE_TRAIN"), (("tuning", "selection", "r0"), "SELECTION_OUTSIDE_INNER_VALIDATION"),
    (("model_fit", "fit", "r5"), "OUTER_TEST_IN_FIT_OR_SELECTION"), (("tuning", "calibration", "r5"), "TEST_TIME_CALIBRATION"),
    (("final_scoring", "fit", "r0"), "FINAL_SCORING_FITS_OR_SELECTS"), (("final_scoring", "outer_test_read", "r0"), "FINAL_SCORING_READS_NON_TEST"),
    (("tuning", "outer_test_read", "r5"), "OUTER_TEST_READ_EARLY"), (("guess", "fit", "r0"), "UNKNOWN_STAGE_TYPE"), (("tuning", "fit", "r3"), "INNER_VALIDATION_ENTERS_FIT"),
])
def test_ledger_mutations(spark, roles, extra, error):
    assert error in errors(spark, roles, extra)


def test_fit_in_another_stage_is_no_mixing(spark, roles):
    assert "INNER_VALIDATION_ENTERS_FIT" not in errors(spark, roles, ("model_fit", "fit", "r3"))


def test_clean_ledger_and_gate(spark, roles):
    clean = au.build_ledger(roles, CELL, "record_id", "run")
    assert au.validate_ledger(clean, roles, CELL).isEmpty()
    au.scoring_gate(clean, roles, CELL)
    bad = clean.withColumn("record_id", F.when(F.col("record_id") == "r0", "r6").otherwise(F.col("record_id")))
    with pytest.raises(ValueError):
        pr.gated_cross_fit(None, bad, roles, CELL)


def test_role_violations(spark, roles):
    wide = roles.withColumn("s", F.col("record_id"))
    records = roles.select("record_id")
    rule = {"isolation": "s"}
    assert au.role_violations(wide, records, CELL, "record_id", rule).isEmpty()
    twice = wide.unionByName(wide.filter("record_id = 'r5'").withColumn("role", F.lit("train")))
    assert {r["rule"] for r in au.role_violations(twice, records, CELL, "record_id", rule).collect()} == {"isolation", "record_in_two_roles"}
    assert {r["rule"] for r in au.role_violations(wide.filter("record_id <> 'r1'"), records, CELL, "record_id", rule).collect()} == {"records_not_covered"}


def embeddings_of(material, summary):
    return sum(all(material[p] == v for p, v in zip(spots, summary)) for spots in itertools.combinations(range(len(material)), len(summary)))


def test_sequence_join_equals_brute_force(spark):
    rng = random.Random(9)
    material, summary, want = [], [], {}
    for s in range(60):
        m = [rng.choice("abcdefgh"[: rng.choice([2, 8])]) for _ in range(rng.randint(1, 8))]
        w = [v for v in m if rng.random() < 0.6] or [m[0]]
        if rng.random() < 0.3:
            rng.shuffle(w)
        n = embeddings_of(m, w)
        want[s] = "SOURCE_SLOT_JOIN_VERIFIED" if n == 1 else "BLOCKED_NONUNIQUE_ORDERED_JOIN" if n else "BLOCKED_UNMATCHED_ORDERED_JOIN"
        material += [(s, i, v) for i, v in enumerate(m)]
        summary += [(s, i, v) for i, v in enumerate(w)]
    m, w = (spark.createDataFrame(x, "s int, i int, v string") for x in (material, summary))
    status, slots = sq.prove_sequence_join(m, w, "s", "i", "v")
    assert {r["s"]: r["status"] for r in status.collect()} == want
    assert len(set(want.values())) == 3
    place = {(s, i): v for s, i, v in material}
    text = {(s, i): v for s, i, v in summary}
    for r in slots.collect():
        assert want[r["s"]] == "SOURCE_SLOT_JOIN_VERIFIED" and place[(r["s"], r["pos"])] == text[(r["s"], r["idx"])]


def test_repeating_texts_are_cut_at_forced_slots(spark, monkeypatch):
    """200,000 rows of two alternating texts: no slot is left to the greedy pass; a missing pair gives room."""
    seen = []
    wrap = sq.durable

    def note(df):
        seen.append(wrap(df))
        return seen[-1]

    monkeypatch.setattr(sq, "durable", note)
    n = 200_000
    m = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("v"))
    status, slots = sq.prove_sequence_join(m, m, "s", "i", "v")
    assert [tuple(r) for r in status.collect()] == [("s", n, n, "SOURCE_SLOT_JOIN_VERIFIED")]
    assert slots.filter("idx = pos").count() == n
    anchors = next(d for d in seen if d.columns == ["s", "idx", "pos"])
    assert anchors.count() == n  # nothing is open, so no task holds a stretch
    m = m.filter("i < 4000")
    for gone, verdict in (("0, 1000, 3999", "SOURCE_SLOT_JOIN_VERIFIED"), ("1000, 1001", "BLOCKED_NONUNIQUE_ORDERED_JOIN")):
        status, _ = sq.prove_sequence_join(m, m.filter(f"i not in ({gone})"), "s", "i", "v")
        assert [r["status"] for r in status.collect()] == [verdict]
    status, _ = sq.prove_sequence_join(m.filter("i <> 7"), m, "s", "i", "v")
    assert [r["status"] for r in status.collect()] == ["BLOCKED_UNMATCHED_ORDERED_JOIN"]


def test_slices(spark):
    path = spark.createDataFrame([("p", i, v) for i, v in enumerate("abcabd")], "s string, at int, v string")
    samples = spark.createDataFrame([("p", n, i, v) for n, t in (("one", "abd"), ("two", "ab"), ("none", "ad")) for i, v in enumerate(t)], "s string, n string, at int, v string")
    got = {r["n"]: (r["status"], r["start"]) for r in sq.locate_slices(path, samples, "s", "n", "at", "v").collect()}
    assert got == {"one": ("UNIQUE", 3), "two": ("AMBIGUOUS", None), "none": ("ABSENT", None)}


def test_slices_with_a_frequent_first_value(spark):
    """One value in half of the path; every start of it would have cost as many rows as the samples are long."""
    rng = random.Random(3)
    paths = {"p": ["a" if rng.random() < 0.5 else rng.choice("bc") for _ in range(6000)], "q": ["a"] * 40, "r": [None, "a", "b"]}
    samples = {("p", f"{k}-{n}"): paths["p"][k:k + n] for k in range(0, 5800, 290) for n in (3, 12, 180)}
    samples |= {("p", "changed"): paths["p"][100:300][:-1] + ["z"], ("q", "all"): ["a"] * 40, ("q", "some"): ["a"] * 38, ("q", "long"): ["a"] * 41, ("x", "no path"): ["a"],
                ("r", "null"): [None, "a"], ("r", "end"): ["a", "b"]}
    want = {}
    for (s, n), v in samples.items():
        p = paths.get(s, [])
        found = [i for i in range(len(p) - len(v) + 1) if None not in v and p[i:i + len(v)] == v]
        want[s, n] = (len(found), found[0] if len(found) == 1 else None, "UNIQUE" if len(found) == 1 else "AMBIGUOUS" if found else "ABSENT")
    path = spark.createDataFrame([(s, i, v) for s, p in paths.items() for i, v in enumerate(p)], "s string, at long, v string")
    given = spark.createDataFrame([(s, n, i, v) for (s, n), t in samples.items() for i, v in enumerate(t)], "s string, n string, at long, v string")
    got = {(r["s"], r["n"]): (r["matches"], r["start"], r["status"]) for r in sq.locate_slices(path, given, "s", "n", "at", "v").collect()}
    assert got == want and {w[2] for w in want.values()} == {"UNIQUE", "AMBIGUOUS", "ABSENT"}
    assert {r["status"] for r in sq.locate_slices(path.limit(0), given, "s", "n", "at", "v").collect()} == {"ABSENT"}
    assert sq.locate_slices(path, given.limit(0), "s", "n", "at", "v").count() == 0


def test_digests_ignore_order_and_see_changes(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    d = lambda x: dg.table_digest(x).first()["table_digest"]
    assert d(df) == d(df.orderBy(F.col("id").desc()).select("v", "id"))
    assert d(df) != d(df.withColumn("v", F.when(F.col("id") == 3, 9).otherwise(F.col("v")))) and d(df) != d(df.unionByName(df.limit(1)))


def test_observation_faults(spark):
    records = spark.createDataFrame([("r1", "a"), ("r2", "b")], "r string, s string")
    obs = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r9", "a"), ("", "a"), ("r2", " ")], "r string, s string")
    good, bad = jn.checked_observations(obs, records, "r", ["s"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["EMPTY_REQUIRED_FIELD", "EMPTY_REQUIRED_FIELD", "IDENTITY_MISMATCH", "UNKNOWN_RECORD"]


def test_numbered_rows_keep_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1;"x;y";z\n\n2;b;c\n')
    rows = scans.read_numbered_rows(spark, str(tmp_path), ["p", "q", "r"]).orderBy("row_number").collect()
    assert [(r["row_number"], r["p"], r["q"]) for r in rows] == [(1, "1", "x;y"), (3, "2", "b")]


def test_manifest_and_cache(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("abc")
    m = scans.file_manifest(spark, str(tmp_path / "d"))
    assert m.first()["bytes"] == 3
    wrong = m.withColumn("sha256", F.lit("0")).unionByName(m.withColumn("name", F.lit("gone")))
    assert {r["name"]: r["status"] for r in scans.reconcile(wrong, m).collect()} == {"f.txt": "HASH_MISMATCH", "gone": "MISSING"}
    root = str(tmp_path / "stage")
    assert sinks.stage_table(spark, root, "k", lambda: spark.range(3)).count() == 3
    assert sinks.stage_table(spark, root, "k", lambda: spark.range(9)).count() == 3
    assert sinks.stage_table(spark, root, "other", lambda: spark.range(9)).count() == 9


def test_ledger_sink_is_sorted(spark, tmp_path):
    sinks.write_ledger(spark.createDataFrame([("b", 1), ("a", 2)], "z string, a int"), str(tmp_path / "l"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()] == ['{"a":1,"z":"b"}', '{"a":2,"z":"a"}']


def test_forbidden_fields(spark):
    schema = spark.sql("select named_struct('eeg_x', 1, 'ok', array(named_struct('Outcome', 2))) s, map('k', named_struct('eye', 1)) m").schema
    assert scans.forbidden_fields(schema, ["eeg", "outcome"]) == ["s.eeg_x", "s.ok[].Outcome"]
    with pytest.raises(ValueError):
        scans.require_fields(spark.range(1), ["id", "nope"])


def test_decisions(spark):
    rows = spark.createDataFrame([("a", "t1", True, 0.1, 12, 0.2), ("a", "t2", True, 0.1, 12, 0.3), ("b", "t1", True, 0.1, 12, 0.9), ("b", "t2", True, -0.1, 12, 0.9)],
                                 "c string, task string, family_detected boolean, ci_low double, positive_entities int, estimate double")
    r = dc.select_candidate(rows, "c", "task").first()
    assert (r["selected"], r["outcome"], r["tasks"]) == ("a", "PASS_ALL_TASKS", "t1,t2")
    assert dc.select_candidate(rows.withColumn("ci_low", F.lit(-1.0)), "c", "task").first()["outcome"] == "FAIL"
    faults = dc.population_errors(spark.createDataFrame([("a", 1), ("a", 2), ("", 1), ("c", 0)], "e string, n int"), "e", "n")
    assert sorted(r["fault"] for r in faults.collect()) == ["BLANK_ENTITY", "NO_ELIGIBLE_CELL", "REPEATED_ENTITY"]


def test_label_and_rebuild(spark):
    df = spark.range(50).select("id", (F.col("id") % 2 == 0).alias("flag"))
    assert au.label_invariance(lambda d: d.select("id"), df, "flag").first()["invariant"]
    assert not au.label_invariance(lambda d: d.filter("flag"), df, "flag").first()["invariant"]
    assert au.rebuild_agrees(lambda d: d.groupBy("flag").count(), df).first()["identical"]


def test_fold_violations_equal_those_of_the_roles(spark):
    import random

    from heldout.operators.splits import cell_roles

    rnd = random.Random(2)
    rows = [(f"r{i % 190}", f"s{rnd.randint(0, 9)}", f"m{rnd.randint(0, 30)}", rnd.randint(0, 3), rnd.randint(0, 2)) for i in range(200)]
    a = spark.createDataFrame(rows, "record_id string, subject_id string, stimulus_id string, subject_fold int, text_fold int")
    records = spark.createDataFrame([(f"r{i}",) for i in range(195)], "record_id string")
    members, cell = {"subject": "subject_id", "stimulus": "stimulus_id"}, ["cell_subject", "cell_text"]
    key = lambda df: sorted((r.cell_subject, r.cell_text, r.rule, r.violations) for r in df.collect())
    assert key(au.fold_violations(a, records, "record_id", members, 4, 3)) == key(au.role_violations(cell_roles(a, 4, 3), records, cell, "record_id", members))


def test_table_manifest_takes_a_folder_of_parts_as_one_table(spark, tmp_path):
    from heldout.sources import scans

    (tmp_path / "b.parquet").mkdir()
    for name, text in (("a.parquet", "one"), ("b.parquet/p0.parquet", "two"), ("b.parquet/p1.parquet", "three")):
        (tmp_path / name).write_text(text)

    def manifest():
        files = scans.file_manifest(spark, str(tmp_path), "*.parquet")
        return files, {r["name"]: (r["bytes"], r["sha256"]) for r in scans.table_manifest(files, ".parquet").collect()}

    files, first = manifest()
    assert first["a.parquet"] == tuple(files.filter("name = 'a.parquet'").select("bytes", "sha256").first())
    assert {k: v[0] for k, v in first.items()} == {"a.parquet": 3, "b.parquet": 8}
    (tmp_path / "b.parquet/p1.parquet").write_text("thr33")
    _, second = manifest()
    assert second["b.parquet"][0] == 8 and second["b.parquet"] != first["b.parquet"] and second["a.parquet"] == first["a.parquet"]


def test_marked_ledger_equals_the_long_one(spark):
    from heldout.operators import splits

    rnd = random.Random(5)
    rows = [(f"r{i % 70}", rnd.choice([None, 0, 1, 2, 3]), rnd.randint(0, 2)) for i in range(75)]
    a = spark.createDataFrame(rows, "record_id string, subject_fold int, text_fold int").withColumn("marks", splits.cell_marks(4, 3))
    cell, key = ["cell_subject", "cell_text"], lambda df: sorted(map(tuple, df.collect()))
    long_form = splits.cell_roles(a.drop("marks"), 4, 3)
    assert key(splits.marked_cells(a.select("record_id", "marks"), "marks", 3)) == key(long_form.select("record_id", *cell, "role"))
    truth = a.drop("marks").withColumn("text_fold", F.when(F.col("record_id") < "r3", 1).otherwise(F.col("text_fold"))).filter("record_id <> 'r5'")
    ledger = au.build_ledger(long_form, cell, "record_id", "run")
    got = au.validate_marked_ledger(a.select("record_id", "marks"), truth, "marks", 3, "record_id", ["subject_fold", "text_fold"], "run")
    want = key(au.validate_ledger_by_folds(ledger, truth, cell, "record_id", ["subject_fold", "text_fold"]))
    assert len(want) > 10 and key(got.select("run_id", "stage_type", "error", "records")) == want
    counted = au.counted_ledger(a, "marks", 3, "run")
    assert key(au.ledger_accounting(counted, 12, "records")) == key(au.ledger_accounting(ledger, 12))
    assert counted.agg(F.sum("records")).first()[0] == ledger.count()


def test_no_record_is_copied_per_cell(spark, monkeypatch, tmp_path):
    """Records alike in their folds are counted before the cells are made."""
    from heldout.operators import splits

    a = spark.range(3000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 2).cast("int").alias("subject_fold"), (F.col("id") % 3).cast("int").alias("text_fold"))
    seen = []
    monkeypatch.setattr(au, "marked_cells", lambda df, *rest: seen.append(df.count()) or splits.marked_cells(df, *rest))
    au.validate_marked_ledger(a.withColumn("marks", splits.cell_marks(2, 3)), a, "marks", 3, "record_id", ["subject_fold", "text_fold"], "run").collect()
    assert seen == [6]


def test_manifest_reads_no_file_as_one_value(spark, tmp_path):
    """Hashes of odd bytes are right, and of plain names none is a value of the size of its file."""
    import gzip
    import hashlib

    rnd = random.Random(3)
    odd = {"feeds.bin": b"\n\n\r\r\n", "mark.txt": b"\xef\xbb\xbfa\n\xff\xfe", "mark_end.txt": b"\xef\xbb\xbfa\n", "mark_only.txt": b"\xef\xbb\xbf", "three.txt": b"a\nb", "noise.bin": rnd.randbytes(300_000),
           "zeros.bin": bytes(70_000), "a [1] b%20#.bin": b"x\n", "ok.gz": gzip.compress(b"abc\n" * 99), "broken.gz": b"abc\n", "sub/f.txt": b"f"}
    (tmp_path / "sub").mkdir()
    for name, data in odd.items():
        (tmp_path / name).write_bytes(data)

    def manifest():
        return {r["name"]: (r["bytes"], r["sha256"]) for r in scans.file_manifest(spark, str(tmp_path)).collect()}

    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in odd.items()}
    assert manifest() == want
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10_000)  # one value has a limit, as above 2 GB
    try:
        assert manifest() == want
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
