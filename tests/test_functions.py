"""Scalar and array functions against the standard library and numpy."""

import hashlib
import math
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from heldout.functions import hashing as H
from heldout.functions import parsing as P
from heldout.functions import text as X
from heldout.functions import vectors as V


def test_seed_and_mod(spark):
    df = spark.range(50).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    for r in df.select("k", H.stable_seed(F.lit("s"), "k").alias("s"), H.hash_mod(H.sha256("k"), 200).alias("m")).collect():
        h = hashlib.sha256(f"s|{r['k']}".encode()).hexdigest()
        assert r["s"] == int(h[:16], 16) % (2**63 - 1)
        assert r["m"] == int(hashlib.sha256(r["k"].encode()).hexdigest(), 16) % 200


def test_normal_forms(spark):
    words = ["Straße ", "ﬁne text", "Ⅷ", "  ÉTÉ ;;", "é"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", X.fold_text(F.col("w")).alias("f"), X.compose_text(F.col("w")).alias("c"), X.fold_without_spaces(F.col("w")).alias("n")).collect():
        nf = unicodedata.normalize("NFKC", r["w"])
        assert r["f"] == nf.strip().casefold() and r["c"] == nf.strip()
        assert r["n"] == "".join(nf.casefold().split())


def test_item_reasons(spark):
    df = spark.createDataFrame([("NaN",), ("12,5",), ("word",), ("a@b",), ("",), (None,)], "w string")
    got = [r[0] for r in df.select(X.item_reason(F.col("w"), ~F.col("w").contains("@"))).collect()]
    assert got == ["placeholder_or_empty", "numeric_or_nonlexical", None, "official_is_real_word_false", "placeholder_or_empty", "placeholder_or_empty"]


def test_length_band_edges(spark):
    df = spark.createDataFrame([(4, 3), (4, 5), (4, 2), (4, 6), (100, 75), (100, 74), (100, 125), (100, 126)], "a int, b int")
    assert [r[0] for r in df.select(P.length_legal(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, True, False, True, False]


def test_similarity_edge(spark):
    df = spark.createDataFrame([(0.9,), (math.nextafter(0.9, 1.0),)], "c double")
    assert [r[0] for r in df.select(P.similarity_legal(F.col("c"), 0.9)).collect()] == [True, False]


def test_counts_and_booleans(spark):
    df = spark.createDataFrame([("3",), ("3.5",), ("-1",), ("nan",), ("x",), (None,), ("inf",), ("7.0",)], "c string")
    assert [r[0] for r in df.select(P.count_or_null(F.col("c"))).collect()] == [3, None, None, None, None, None, None, 7]
    b = spark.createDataFrame([(" Yes ",), ("excluded",), ("?",), (None,)], "c string")
    assert [r[0] for r in b.select(P.lenient_bool(F.col("c"))).collect()] == [True, False, True, True]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=6)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.unit(F.col("a")).alias("u"), V.permute_blocks(F.col("a"), F.array(F.lit(2), F.lit(0), F.lit(1)), 2).alias("p"),
                  V.inject(F.col("a"), F.col("b"), F.lit(0.0)).alias("z"), V.pad(F.col("a"), F.lit(8), 0.0).alias("pad")).first()
    assert np.isclose(r["d"], a @ b) and np.allclose(r["u"], a / np.linalg.norm(a))
    assert np.allclose(r["p"], np.r_[a[4:], a[:4]]) and r["z"] == a.tolist() and len(r["pad"]) == 8
    m = spark.createDataFrame([([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]],)], "m array<array<double>>")
    assert m.select(V.transpose(F.col("m"))).first()[0] == [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]]


def test_sorted_reasons(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False), (None, True)], "a boolean, b boolean")
    got = [r[0] for r in df.select(P.reasons((F.col("b"), "B"), (F.col("a"), "A"))).collect()]
    assert got == [["A", "B"], ["B"], [], ["B"]]


def test_hash_mod_of_large_numbers(spark):
    import hashlib

    from heldout.functions.hashing import hash_index, hash_mod, sha256

    n = 3 * 2**40 + 7
    df = spark.range(50).select("id", sha256("id").alias("h"), hash_mod(sha256("id"), n).alias("m"), hash_index(n, "id").alias("i"))
    for r in df.collect():
        number = int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16)
        assert r.m == number % n and r.i == (number >> 196) % n


def test_folded_words_leave_no_target_token(spark):
    from heldout.operators import sequences as Q

    rows = [("c", 0, ["STRASSE", "ｗｏｒｄ", "stays"]), ("c", 1, ["Straße", "word"])]
    df = spark.createDataFrame(rows, "conv string, turn long, words array<string>")
    got = {r.turn: r for r in Q.history_context(df, ["conv"], "turn", "words").collect()}
    assert got[1].history == ["stays"] and got[0].history == []
    leaky = spark.createDataFrame([(["Straße"], ["STRASSE"]), (["a"], ["b"])], "words array<string>, history array<string>")
    a = Q.audit_history(leaky, F.col("words"), F.col("history"), F.array(F.lit(0)), F.lit(1), F.lit("H_full"), F.array(F.lit("tokens")))
    assert [r.target_tokens_absent for r in a.collect()] == [False, True]


def test_full_width_placeholder(spark):
    df = spark.createDataFrame([("ＮＡ",), ("word",)], "w string")
    assert [r[0] for r in df.select(X.item_reason(F.col("w"))).collect()] == ["placeholder_or_empty", None]


def test_forbidden_keys_at_any_depth(spark):
    from heldout.sources import scans

    df = spark.createDataFrame([('{"a": {"eeg.x": 1, "b": "outcome"}, "c": [{"Outcome": 2}], "d\\"q": ":"}',)], "p string")
    assert {r.payload_key for r in scans.forbidden_payload_keys(df, "p", ["eeg.", "outcome"]).collect()} == {"eeg.x", "Outcome"}


def test_files_of_one_name_stay_apart(spark, tmp_path):
    from heldout.sources import scans

    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.csv").write_text("1;2\n3;4\n")
    rows = scans.read_numbered_rows(spark, str(tmp_path / "*"), ["p", "q"])
    assert rows.count() == 4
    m = scans.file_manifest(spark, str(tmp_path))
    assert {r["name"] for r in m.collect()} == {"a/f.csv", "b/f.csv"}
    assert {r["status"] for r in scans.reconcile(m.filter("name = 'a/f.csv'"), m).collect()} == {"VERIFIED", "NOT_IN_MANIFEST"}
