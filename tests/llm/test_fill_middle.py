import hashlib
import random
import re

import pytest

from heldout.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < 80
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def corpus(odd):
    rnd = random.Random(1)
    alphabet = ["a", "bc", " ", "  ", "\n", "\t\r", "é", "日本", "\U0001f600", "\x85", "\xa0", "<", "<P", "P>", "<M"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))), "s") for i in range(400)]
    rows += [(1000 + i, t, "s") for i, t in enumerate(["<P>", "x<S>", "a <M> b", "<Q> a", "<", "<P", "P>", " ", "\n\n", "a", " a", "a "] * 12)]
    return rows + odd


def test_equals_brute_force_and_round_trip(spark, make, odd):
    rows = corpus(odd)
    docs = make(rows).selectExpr("*", "'x' as form", "'y' as restored")
    out = M.restore(M.transform(docs))
    assert out.columns == [c for c in docs.columns if c not in ("n", "form", "restored")] + ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((brute(i, t) for i, t, _ in rows), key=key)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == set(M.FORMS)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_do_not_matter(spark, make, odd, size, monkeypatch):
    """Any cut of a batch, down to single rows, gives the same outputs."""
    import pyarrow as pa

    from heldout.llm.pieces import byte_rows, cut

    texts = [t for _, t, _ in corpus(odd[:6])]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    parts = list(cut(batch, "text", size))
    assert sum(p.num_rows for p in parts) == len(texts)
    rows = []
    for p in parts:
        data, bounds = byte_rows(p.column(0))
        rows += [bytes(data[a:b]).decode() for a, b in zip(bounds, bounds[1:])]
    assert rows == [t or "" for t in texts]


def test_empty_table(spark, make):
    assert M.restore(M.transform(make([]))).count() == 0


def test_broken_outputs_raise(spark):
    for output, form in (("no marks", "psm"), ("<S>a<P>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("x<P>a<S>b<M>c", "psm"), ("a", "none")):
        with pytest.raises(Exception, match="marks|none"):
            M.restore(spark.createDataFrame([(output, form)], "output string, form string")).collect()
