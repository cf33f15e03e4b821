import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from heldout.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, times=4):
    """All maximal stretches of each period, kept where no smaller period has the same stretch."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(least, times * q) and not any((start, length, d) in seen for d in range(1, q) if q % d == 0):
                out.append((start, length, q))
                seen.add((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(words, least=6, times=4):
    w = np.array(words, np.int64)
    return sorted(P.find_runs(w, np.zeros(len(w), np.int64), np.full(len(w), len(w)), least, times), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    words = []
    while len(words) < rnd.randint(1, 120):
        period = [rnd.randrange(1 + seed % 4) for _ in range(rnd.randint(1, 7))]
        words += (period * rnd.randint(1, 9))[: rnd.randint(1, 40)]
    assert found(words) == brute_runs(words)
    assert found(words, 3, 2) == brute_runs(words, 3, 2)
    assert found(words, 20, 3) == brute_runs(words, 20, 3)


def test_texts_do_not_meet():
    """Equal words at the end of one text and the start of the next make no run together."""
    words, row = np.zeros(10, np.int64), np.repeat([0, 1], 5)
    assert P.find_runs(words, row, np.array([5, 10])[row]) == []
    row = np.repeat([0, 1], [4, 6])
    assert P.find_runs(words, row, np.array([4, 10])[row]) == [(4, 6, 1)]


def test_long_periodic_text():
    """Blocks of positions split; every length of common prefix occurs."""
    for n, q in ((5000, 1), (5001, 7), (4000, 1000)):
        words = [i % q for i in range(n)]
        assert found(words) == [(0, n, q)]


def plant(doc_id, words):
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute(doc_id, text):
    words = plant(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(words, runs))


@pytest.mark.parametrize("case", ["words", "odd", "empty"])
def test_query_equals_brute_force(spark, make, odd, case):
    rnd = random.Random(case)
    if case == "words":
        rows = []
        for i in range(400):
            words = [rnd.choice(["a", "b", "É", "日本"]) for _ in range(rnd.randint(0, 60))]
            rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words + ["x", "y"] * rnd.randint(0, 6)), "s"))
    else:
        rows = {"odd": [(i, t if t is None or len(t) < 50_000 else t[:4_000], s) for i, t, s in odd], "empty": []}[case]
    got = [tuple(r) for r in P.op12(make(rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((brute(i, t) for i, t, _ in rows), key=key)


def test_very_long_text_and_other_columns(spark, make):
    docs = make([(6, "word " * 200_000, "s"), (7, None, None)]).selectExpr("*", "1 as runs", "2 as `row`", "3 as n_words")
    out = P.collapse(docs)
    assert out.columns == [c for c in docs.columns if c not in ("runs", "n_words")] + ["n_words", "runs", "collapsed"]
    got = {r.doc_id: r for r in out.collect()}
    assert [tuple(x) for x in got[6].runs] == [(0, 200_000, 1)] and got[6].collapsed == "word" and got[6]["row"] == 2
    assert (got[7].n_words, got[7].runs, got[7].collapsed) == (0, [], "")


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 8_000]
    got = {r.doc_id: tuple(r) for r in P.op12(docs).collect()}
    assert len(got) == docs.count() and len(rows) > 100
    assert all(got[i] == brute(i, t) for i, t in rows)
