import hashlib
import random

import numpy as np
import pytest

from heldout.llm import suffix_dedup as S


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = {}
    for _, b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[: len(b)]
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("case", ["near", "periodic", "odd", "empty"])
@pytest.mark.parametrize("largest", [4096, 2])
def test_equals_brute_force(spark, make, odd, case, largest):
    rnd = random.Random(case)
    if case == "near":
        base = "".join(rnd.choice("abcdefgh é") for _ in range(900))
        rows = []
        for i in range(30):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = "X"
            rows.append((i, "".join(t)[rnd.randint(0, 200) :] + str(i), "s"))
        rows += [(50, rows[0][1], "s"), (51, base[100:400] * 2, "s"), (52, base[:99], "s")]
    elif case == "periodic":
        rows = [(1, "ab" * 400, "s"), (2, "ab" * 30 + "c" + "ab" * 80, "s"), (3, "a" * 150, "s"), (4, "x" + "a" * 120, "s"), (5, "abc" * 50, "s")]
    else:
        rows = {"odd": odd[:6] + odd[8:], "empty": []}[case]
    out = S.removed(make(rows), length=100, width=40, largest=largest)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows, 100), key=key)


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order(seed):
    rnd = random.Random(seed)
    text = bytes(rnd.choice(b"ab\x00c"[: 1 + seed % 4]) for _ in range(rnd.randint(1, 80)))
    wanted = np.array([rnd.random() < 0.7 for _ in text])
    assert S.suffix_order(text, wanted, 100).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:])


def test_equal_windows_share_their_anchor():
    rnd = random.Random(9)
    common = bytes(rnd.choice(b"abcd") for _ in range(300))
    find = S.Anchors(100, 40)
    places = []
    for k in range(2):
        text = bytes(rnd.choice(b"abcd") for _ in range(50 + 37 * k)) + common
        anchor, _, first, windows = find(text)
        places.append({int(w) - 50 - 37 * k: int(a) for a, f, n in zip(anchor, first, windows) for w in range(f, f + n) if w >= 50 + 37 * k})
    assert places[0] == places[1] and len(places[0]) == 201
