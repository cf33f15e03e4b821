import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heldout.llm import quality_rules as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, make, odd):
    rows = [*odd, (20, "a b c a b c a b", "s"), (21, "a a a a", "s"), (22, "l one\nl one\n\n \nl two\nl one", "s"), (23, "a b c d a b c", "s"), (24, "# * $%&|<> ab", "s")]
    docs = make(rows)
    out = Q.judged(docs, [])
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert (r._q.n_words, r._q.word_chars, r._q.n_symbols, r._q.n_dup_lines, r._q.n_repeat_words) == brute(r.text)
        n, rep = r._q.n_words, r._q.n_repeat_words
        assert r._base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r._kept == (not r._base_failed)


def test_rules_separate_planted_junk(spark, make):
    clean = lambda i: " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(60 + i % 40))
    rows = [(i, clean(i) if i % 4 else clean(i).replace(" ", " ## ") if i % 8 else clean(i).upper() + "!!", "s") for i in range(400)]
    docs, labels = make(rows), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules and all(len(r) <= 3 for r in rules)
    fresh = make([(i, clean(i * 7 + 3), "s") for i in range(100)] + [(1000 + i, clean(i).replace(" ", " && "), "s") for i in range(50)])
    kept = {r.doc_id: r._kept for r in Q.judged(fresh, rules).collect()}
    assert all(kept[i] for i in range(100)) and not any(kept[1000 + i] for i in range(50))


def test_without_labels_or_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(make([(1, "a", "s")]), none) == []
    assert Q.judged(make([]), []).count() == 0


def test_growing_reaches_the_best_threshold(spark):
    """One condition splits the classes: it must be found, and lie half-way."""
    rows = [(float(i), i >= 70, i % 3) for i in range(100)]
    table = spark.createDataFrame(rows, "x double, bad boolean, _part int")
    zero = [F.lit(0.0).alias(f) for f in Q.FEATURES[1:]]
    rules = Q.learn(table.select(F.struct(F.col("x").alias(Q.FEATURES[0]), *zero).alias("_q"), "bad", "_part"), bins=100)
    assert len(rules) == 1 and rules[0][0].above and rules[0][0].threshold == pytest.approx(69.5, abs=1.01)
