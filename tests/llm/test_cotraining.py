import numpy as np

from heldout.llm import cotraining as C


def test_held_out_accuracy(spark):
    """Labels with odd ids train, the others judge."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = C.scored(docs, labels.filter("doc_id % 2 = 1"))
    judged = out.join(labels.filter("doc_id % 2 = 0"), "doc_id").select("quality", "kept", "text_score", "meta_score").collect()
    for c in ("kept", "text_score", "meta_score"):
        good = [float(r[c]) >= 0.5 for r in judged if r.quality == 1]
        bad = [float(r[c]) < 0.5 for r in judged if r.quality == 0]
        assert len(bad) > 50 and sum(good) >= 0.95 * len(good), c
        assert sum(bad) >= (0.9 if c == "kept" else 0.7) * len(bad), (c, sum(bad) / len(bad))
    assert out.count() == docs.count()


def test_odd_rows(spark, make, odd):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = C.scored(make(odd), labels).collect()
    assert len(rows) == len(odd)
    assert all(r.score == 0 and not r.kept for r in rows if r.doc_id in (1, 2)) and all(r.score == 0.5 for r in rows if r.doc_id == 5)
    both = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (7, 0), (7, 1)], "doc_id long, quality int")
    scores = [(r.doc_id, r.score) for r in C.scored(make(odd), both).collect()]
    assert scores.count(next(s for s in scores if s[0] == 4)) == 2  # repeated rows agree
    assert C.scored(make([]), both).count() == 0


def test_one_exchange_equals_brute_force(spark, make):
    """All unlabelled rows take part; the surest of every source in turn go over, and none twice."""
    rows = [(i, "word " * (i % 11 + 1) + "abcdefgh"[: i % 7 + 1] * (i % 5), f"s{i % 3}" if i % 2 else "hot") for i in range(400)]
    docs = make(rows)
    table = C.seen(docs, spark.createDataFrame([(i, i % 2) for i in range(0, 400, 9)], "doc_id long, quality int"))
    free = table.filter("q is null").withColumn("mark", C.F.xxhash64("x", "m"))
    held = free.collect()
    assert len(held) == 400 - 45
    known = table.filter("q is not null").collect()
    y = np.array([float(r.q) for r in known])
    models = [C.Logistic.fit(C._stack([r[c] for r in known], c), y) for c in "xm"]
    surest, used = C._exchange(free, len(held)), set()
    for _ in range(2):
        got, taken = surest(models, 0.5), set()
        for k in (0, 1):
            want = []
            for label, sign in ((0, 1), (1, -1)):
                left = [r for r in held if (r.doc_id, r.mark) not in used]
                far = sign * models[k].raw(C._stack([r["xm"[k]] for r in left], "xm"[k]))
                turns = {}
                order = []
                for f, i, mark, r in sorted(((f, r.doc_id, r.mark, r) for f, r in zip(far.tolist(), left, strict=True)), key=lambda v: v[:3]):
                    turns[r.source] = turns.get(r.source, 0) + 1
                    order.append((turns[r.source], f, i, mark, r))
                best = sorted(order, key=lambda v: v[:4])[: max(1, round(int(C.TAKEN * 355) * 0.5))]
                taken |= {(b[2], b[3]) for b in best}
                want += [(b[4]["mx"[k]], label) for b in best]
            assert np.array_equal(got[k][0], C._stack([w[0] for w in want], "mx"[k])) and got[k][1].tolist() == [w[1] for w in want]
        used |= taken
