import random
import re
from collections import defaultdict

import pytest

from heldout.llm import ngram_join as N
from heldout.llm.linking import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((i for i in least[find(k)] if i is not None), default=None)) for k in range(len(rows))]


def near(rnd, words, share):
    return " ".join(rnd.choice(["alter", "other", "third"]) + str(rnd.randint(0, 9)) if rnd.random() < share else w for w in words)


@pytest.mark.parametrize("case", ["families", "passage", "odd", "empty"])
def test_equals_brute_force(spark, make, odd, case):
    rnd = random.Random(case)
    word = lambda: "w" + str(rnd.randint(0, 400))
    if case == "families":  # dense families around the threshold, in which links chain
        rows = []
        for f in range(6):
            base = [word() for _ in range(150)]
            rows += [(1000 * f + i, near(rnd, base, rnd.choice([0.005, 0.02, 0.035])), "s") for i in range(40)]
        rows += [(9000 + i, rows[i][1].upper() if i % 2 else rows[i][1], "s") for i in range(20)]
    elif case == "passage":  # a passage in a third of all texts links none of them
        passage = " ".join(word() for _ in range(60))
        rows = [(i, " ".join(word() for _ in range(80)) + (" " + passage if i % 3 == 0 else ""), "s") for i in range(150)]
        rows += [(500 + i, passage + f" tail{i}", "s") for i in range(30)]
    else:
        rows = {"odd": odd, "empty": []}[case]
    got, _ = N.similar(make(rows))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=key) == sorted(brute(rows), key=key)


def test_common_shingles_go_past_the_fragments(spark, make, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 4)
    rnd = random.Random(3)
    rows = []
    for f in range(4):
        base = ["w" + str(rnd.randint(0, 300)) for _ in range(120)]
        rows += [(100 * f + i, near(rnd, base, 0.02), "s") for i in range(25)]
    got, _ = N.similar(make(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute(rows))


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {(k, find(k)) for a, b in pairs if a != b for k in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r.id, r.component) for r in got.collect()} == want
