import hashlib
import zlib

import pytest

from heldout.llm import sharding


def brute(rows, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    md5 = lambda x: "" if x is None else hashlib.md5(str(x).encode()).hexdigest()
    order = sorted((md5(t), md5(i), size(t), i) for i, t, _ in rows)
    total, whole, at = sum(r[2] for r in order), {}, 0
    for g, _, n, _ in order:
        whole.setdefault(g, [at, 0])[1] += n
        at += n
    out, at = [], 0
    for g, _, n, i in order:
        start, group = whole[g]
        middle = 2 * start + group if group <= 0.01 * total / shards else 2 * at + n
        out.append((i, n, min(shards - 1, middle * shards // (2 * total))))
        at += n
    return out


@pytest.mark.parametrize("case", ["plain", "hot", "odd", "empty"])
def test_equals_brute_force(spark, make, odd, case):
    rows = {"plain": [(i, f"text {i % 700} " * (i % 40), "s") for i in range(3000)], "hot": [(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 9), "s") for i in range(3000)], "odd": odd, "empty": []}[case]
    got = sharding.shard(make(rows)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.doc_id, r["size"], r.shard) for r in got], key=key) == sorted(brute(rows), key=key)
    crc = {}
    for i, t, _ in rows:
        crc.setdefault(i, set()).add(zlib.crc32((t or "").encode()))
    slots = {}
    for r in got:
        assert r.text_crc32 in crc[r.doc_id]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if case in ("plain", "hot"):
        sizes = {}
        for r in got:
            sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_written_shards(spark, make, tmp_path):
    docs = make([(i, f"text {i}", "s") for i in range(200)], extra=False)
    placed = sharding.shard(docs, shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}


def test_repeated_rows_are_written_once_each(spark, make, odd, tmp_path):
    docs = make([*odd, *[(7, "the same", "s")] * 40, *[(None, None, "s")] * 40])
    placed = sharding.shard(docs, shards=3)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.shard, r.slot) for r in back) == sorted((r.shard, r.slot) for r in placed.collect())
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in back], key=key) == sorted([(r.doc_id, r.text) for r in docs.collect()], key=key)
