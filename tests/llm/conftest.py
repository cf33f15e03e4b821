import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, with columns that clash with the operators' own names."""

    def build(rows, extra=True):
        rows = [(i, t, s, "en", len(t or "")) for i, t, s in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
        if extra:
            docs = docs.selectExpr("*", "1 as size", "2 as taken", "3 as n", "4 as h", "5 as places", "6 as key", "7 as shard", "8 as ids", "9 as spans", "10 as `_q`", "11 as `_row`")
        return docs

    return build


ODD = [(None, "no id at all " * 9, None), (1, None, "b"), (2, "", "b"), (3, " \n\t\n ", "a"), (4, "one", "a"), (4, "one", "a"), (5, "x" * 30_000, None), (6, "word " * 20_000, "é"), (7, "\U0001f600 日本 ΣΑΣ é " * 40, "\U0001f600")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
