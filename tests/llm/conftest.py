import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(k, n=40):
    return " ".join(WORDS[(k * 7 + i * (k + 3) + i * i) % len(WORDS)] + str((k * 31 + i * i) % 97) for i in range(n))


def document_rows():
    """Ids, texts: plain ones, equal and near copies, null, empty, blank, one word, very long, odd characters; a null id and a repeated row."""
    base = sentence(1, 60)
    rows = [(i, sentence(i + 2)) for i in range(6)]
    rows += [(10, base), (11, base), (12, base + " extra"), (13, base.upper())]
    rows += [(20, None), (21, ""), (22, " \t\n "), (23, "one"), (24, sentence(50, 6000)), (25, "é 日本 😀 ▁ x\x00y\x0bz"), (26, "aaaa" * 500), (27, "123 456 !!")]
    rows += [(None, sentence(60)), (5, sentence(7))]
    return rows


@pytest.fixture
def docs(spark):
    """The rows with further columns whose names the operators use themselves."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "src0", 1, 2, 3.0, [4], "x") for i, t in document_rows()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, id int, n int, score double, ids array<int>, component_id string").repartition(3)


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
