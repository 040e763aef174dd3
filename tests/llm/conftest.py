import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ", cls string, kept string, row string, token string, start string, held string, __row string, __gone string, __more string, gone string, more string, c0 string"


def make(spark, texts, extra=False):
    """documents of the given texts; with extra, columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or "")) + (("x",) * 12 if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + (ODD if extra else ""))


@pytest.fixture
def docs(spark):
    return lambda texts, extra=False: make(spark, texts, extra)


EDGES = [None, "", "   \n\t ", "one", "é ü ß", "a b c d e", "a b c d e", "word " * 3000, "x" * 20000, "a  b\n\nc   d \n", "İstanbul don't <|endoftext|> 'll", "日本語 テキスト😀", None]


@pytest.fixture
def edges():
    return list(EDGES)
