import struct

import pytest
from tokenizers import Tokenizer

from heldout.llm import bpe

TEXTS = ["", None, "Don't we'll I'M 'S", "ΣΑΣ Σ straße é é", "<|endoftext|>a<|startoftext|> b<|endoftext", "a" * 20_000, "word,word!? 12345 x_1", "\x1ca\x1d b c　d\x85e", "日本語 テキスト 🙂🙂", "  \n\t ", "!!! ??? ...", "İstanbul ﬁ Å"]


def unpack(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_equals_the_library(spark, make):
    library = Tokenizer.from_file(bpe.vocabulary_file())
    docs = make([(i, t, "s") for i, t in enumerate(TEXTS)] + [(1, None, None)])
    out = bpe.encode(docs, bpe.vocabulary_file())
    assert set(out.columns) == {*docs.columns, "decoded"}
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert unpack(r.ids) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_query_on_given_table(spark):
    library = Tokenizer.from_file(bpe.vocabulary_file())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.op2(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)


def test_empty_table(spark, make):
    assert bpe.encode(make([]), bpe.vocabulary_file()).count() == 0


@pytest.mark.parametrize("word", ["lower", "xxxxxxxxxxxxxxxx", "e", "thndhain"])
def test_merges_follow_ranks(word):
    """The queue gives what repeated search for the lowest rank gives."""
    encoder = bpe.Encoder(open(bpe.vocabulary_file(), encoding="utf-8").read())
    data = word.encode()
    symbols = [encoder.inner[b] for b in data[:-1]] + [encoder.last[data[-1]]]
    while True:
        ranks = [(encoder.rank.get(a << 20 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        if not ranks or min(ranks)[0] == 1 << 40:
            break
        rank, i = min(ranks)
        symbols[i : i + 2] = [encoder.new[rank]]
    assert encoder.word(data) == symbols
