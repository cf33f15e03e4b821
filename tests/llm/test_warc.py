import base64
import gzip
import hashlib
import random
import uuid
from collections import Counter
from pathlib import Path

import pytest

from heldout.llm import warc as A


def brute(rows, smallest=0):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    led, out = {}, Counter()
    for i, u, h in sorted(rows, key=key):
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) < smallest or data not in led:
            led.setdefault(data, i)
            out[i, len(data), digest, "response", None] += 1
        else:
            out[i, len(data), digest, "revisit", led[data]] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as copy", "3 as shard", "4 as led")


def corpus(n=300):
    rnd = random.Random(n)
    bodies = ["", "<p>é日本\U0001f600</p>", "<p>same</p>\r\n\r\nWARC/1.1\r\n", "x" * 200_000]
    rows = [(i, f"http://a.example/{i}?q=é b\r\nX: y", rnd.choice(bodies[:3]) if rnd.random() < 0.5 else f"<p>{i}</p>" * rnd.randint(1, 40)) for i in range(n)]
    rows += [(None, None, None), (None, "http://n", "<p>null id</p>"), (None, "http://n", "<p>null id</p>"), (5, "http://other", "<p>again</p>"), (5, "http://other", "<p>again</p>"), (6, None, "<p>again</p>"), (-3, "u", bodies[3]), (n, "v", bodies[3])]
    rows += [((1 << 60) + 1, "big", "<p>big</p>"), (1 << 60, "big", "<p>big</p>")]
    return rows


@pytest.mark.parametrize("smallest", [0, 20])
@pytest.mark.parametrize("shard,roll", [(1 << 30, 1 << 30), (20_000, 3_000)])
def test_round_trip(spark, tmp_path, smallest, shard, roll):
    rows = corpus()
    folder = f"{tmp_path}/a"
    listed = A.write(table(spark, rows), folder, smallest=smallest, shard=shard, roll=roll).collect()
    got = A.read(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows, smallest)
    whole = {(h or "").encode() for _, _, h in rows}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == whole
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert sum(r.records for r in listed) == len(rows) + len(listed)
    if roll < 1 << 30:
        assert len({r.shard for r in listed}) > 3 and max(r.number for r in listed) > 0
        assert all(r.compressed >= roll for r in listed if any((s.shard, s.number) == (r.shard, r.number + 1) for s in listed))
    # records come in order over the whole archive
    ids = []
    for r in sorted(listed, key=lambda r: r.name):
        text = gzip.decompress(Path(folder, r.name).read_bytes())
        assert hashlib.sha1(Path(folder, r.name).read_bytes()).hexdigest() == r.sha1
        ids += [x.split(b":")[0] for x in text.split(b"WARC-Record-ID: <urn:page:")[1:]]
    assert [int(x) for x in ids if x] == sorted(int(x) for x in ids if x) and ids[-3:] == [b""] * 3
    assert not Path(folder, "_temporary").exists() and {p.name for p in Path(folder).glob("*.gz")} == {r.name for r in listed}


def test_same_files_on_any_partitioning(spark, tmp_path):
    rows = corpus(100)
    names = []
    for k, parts in enumerate((1, 7)):
        shuffled = random.Random(k).sample(rows, len(rows))
        listed = A.write(table(spark, shuffled).repartition(parts), f"{tmp_path}/{k}", shard=30_000, roll=8_000).collect()
        names.append({(r.name, r.sha1, r.records) for r in listed})
    assert names[0] == names[1] and len(names[0]) > 3


def test_empty_table(spark, tmp_path):
    assert A.write(table(spark, []), f"{tmp_path}/e").count() == 0
    assert A.read(spark, f"{tmp_path}/e").count() == 0


def test_hot_page_is_cut(spark, tmp_path):
    """A page that is there thousands of times is one response and short revisits over several shards."""
    rows = [(1, "u", "<p>hot</p>")] * 3000 + [(i, "v", f"<p>{i}</p>") for i in range(2, 500)]
    listed = A.write(table(spark, rows), f"{tmp_path}/h", shard=200_000).collect()
    got = A.read(spark, f"{tmp_path}/h")
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == brute(rows)
    per_shard = Counter()
    for r in listed:
        per_shard[r.shard] += r.records
    assert len(per_shard) > 8 and max(per_shard.values()) < 900


def test_files_of_lost_attempts_do_not_count(spark, tmp_path):
    """Files of an attempt that Spark did not count are not in the manifest, and committing twice finds the files in place."""
    folder = f"{tmp_path}/l"
    Path(folder, "_temporary").mkdir(parents=True)
    Path(folder, "_temporary", f"pages-00000-00000.warc.gz.{uuid.uuid4().hex}").write_bytes(b"half a file")
    A.write(table(spark, corpus(20)), folder)
    assert A.read(spark, folder).count() == 30
    again = spark.createDataFrame(A.manifest(spark, folder).collect(), A.MANIFEST)
    with pytest.raises(Exception, match="already exists"):
        A._commit(again, folder)  # the manifest is written once


@pytest.mark.parametrize("damage", ["cut", "flip", "gone"])
def test_damage_is_found(spark, tmp_path, damage):
    folder = f"{tmp_path}/d"
    name = A.write(table(spark, corpus(20)), folder).first().name
    path = Path(folder, name)
    data = path.read_bytes()
    if damage == "gone":
        path.rename(tmp_path / "elsewhere")
    else:
        path.write_bytes(data[: len(data) // 2] if damage == "cut" else data[:900] + bytes([data[900] ^ 255]) + data[901:])
    with pytest.raises(Exception):
        A.read(spark, folder).collect()
