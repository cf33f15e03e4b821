"""Trees of digests find exactly the rows that differ."""

from heldout.operators import digests as dg


def test_changed_rows(spark):
    rows = [(i, i % 7, f"v{i}") for i in range(400)] + [(1000, 0, "twice"), (1000, 0, "twice"), (1001, 0, "a"), (1001, 0, "b")]
    other = [(i, k, v + "!" if i in (3, 77) else v) for i, k, v in rows if i != 9] + [(2000, 1, "new")]
    other.remove((1000, 0, "twice"))
    other[other.index((1001, 0, "b"))] = (1001, 0, "c")
    tree = lambda x: dg.digest_tree(spark.createDataFrame(x, "id long, k int, v string"), ["id", "k"])
    got = {(r.id, r.k, r.change) for r in dg.changed_rows(tree(rows), tree(other), ["id", "k"]).collect()}
    assert got == {(3, 3, "CHANGED"), (77, 0, "CHANGED"), (9, 2, "REMOVED"), (2000, 1, "ADDED"), (1000, 0, "CHANGED"), (1001, 0, "CHANGED")}
    assert dg.changed_rows(tree(rows), tree(rows[::-1]), ["id", "k"]).count() == 0
    assert dg.changed_rows(tree([]), tree(rows[:2]), ["id", "k"]).count() == 2


def test_levels_add_up(spark):
    _, levels = dg.digest_tree(spark.createDataFrame([(i, "x") for i in range(300)], "id long, v string"), ["id"], (1, 2, 4))
    assert [levels[n].agg({"rows": "sum"}).first()[0] for n in (1, 2, 4)] == [300] * 3
    assert levels[1].count() == 16


def test_words_of_a_leaf_are_summed_as_long_numbers(spark):
    df = spark.createDataFrame([("a", "f" * 64), ("a", "f" * 64)], "place string, digest string")
    out = dg._sums(df, ["place"])
    assert dict(out.dtypes)["w0"] == "bigint" and out.first()["w7"] == 2 * (2**32 - 1)
