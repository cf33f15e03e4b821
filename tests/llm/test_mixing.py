import hashlib
import re
from collections import defaultdict

import pytest

from heldout.llm import mixing


def brute(rows):
    """Targets by resharing until nothing is above its stop, then the queue of each source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = defaultdict(int)
    for _, t, s in rows:
        sums[s] += size(t)
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sums.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        share = {s: (total - sum(2 * sums[x] for x in full)) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] >= 2 * sums[s]}
        if not over:
            break
        full |= over
        if len(full) == len(order):
            share = {}
            break
    target = {s: share.get(s, 2 * sums[s]) for s in order}
    out = []
    for s in order:
        at, goal = 0, int(target[s] + 0.5)
        queue = sorted((hashlib.md5("|".join(["mix"] + ([str(i)] if i is not None else [])).encode()).hexdigest(), -1 if i is None else i, size(t)) for i, t, x in rows if x == s)
        for _, i, n in queue:
            taken = sum(max(0, min(n, goal - at - k * sums[s])) for k in (0, 1))
            at += n
            out.append((None if i == -1 else i, n, sums[s], taken, target[s]))
    return out


@pytest.mark.parametrize("case", ["plain", "odd", "hot", "empty"])
def test_equals_brute_force(spark, make, odd, case):
    rows = {
        "plain": [(i, "w " * (i * 7 % 50), f"s{i % 5}") for i in range(300)], "odd": odd, "empty": [],
        "hot": [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(600)],
    }[case]
    got = [(r.doc_id, r["size"], r.source_size, r.taken, r.target) for r in mixing.mix(make(rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = brute(rows)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-12)


def test_positions_invert_the_schedule(spark, make):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(90)]
    found = mixing.mix(make(rows)).collect()
    for j, knots in enumerate(mixing.SCHEDULES):
        mine = sorted((r.passes[0]["position"] for r in found if r.source == f"s{j}" and r.passes))

        def served(t):
            area = 0.0
            for (a, u), (b, v) in zip(knots, knots[1:]):
                x = min(max(t, a), b)
                area += (u + (u + (v - u) * (x - a) / (b - a))) / 2 * (x - a)
            return area

        target = next(r.target for r in found if r.source == f"s{j}")
        for k, t in enumerate(mine):
            assert served(t) / served(1.0) == pytest.approx(k * 10 / int(target + 0.5), abs=1e-9)


def test_training_rows_hold_the_words_taken(spark, make, odd):
    docs = make([*odd, *[(i, f"alpha {i}\tbeta\ngamma delta", f"s{i % 4}") for i in range(10, 200)]])
    mixed = mixing.mix(docs)
    rows = mixing.training_rows(docs, mixed)
    assert rows.columns == docs.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = defaultdict(int)
    whole = defaultdict(set)
    for r in docs.collect():
        whole[r.doc_id].add(r.text or "")
    for r in rows.collect():
        words[r.doc_id] += count(r.text)
        assert any(t.startswith(r.text) for t in whole[r.doc_id])
    want = defaultdict(int)
    for r in mixed.collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(words)


def test_rows_of_one_key_share_its_entries(spark, make):
    """The target may end between rows of one key: as many rows come out as there are entries."""
    docs = make([*[(None, "a b c", "s")] * 50, *[(3, "d e f", "s"), (3, "g h i", "s")], (4, "x", "t")])
    mixed = mixing.mix(docs, share=0.3).filter("taken > 0").cache()
    rows = mixing.training_rows(docs, mixed).collect()
    assert 0 < len(rows) == sum(len(r.passes) for r in mixed.collect()) < 53
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in mixed.collect())
