import pytest

from millrace.session import clear_scratch, tune
from tests.harness import session

SMALL = "/root/testdata/sf0.001"
# null ids and texts, empty and blank texts, repeated rows, a very long text, clashing columns
HARD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "same text " * 40, "en"), (4, "same text " * 40, "en"),
    (5, "same text " * 40, "de"), (None, "no id here " * 30, "en"), (6, "x" * 300_000, "en"), (7, "mail a.b@c.de now", ""),
    (8, "é " * 100 + "日本 🙂", "fr"),
]
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, row int, spans string, kept int"


@pytest.fixture(scope="session")
def spark():
    session_ = tune(session(4))
    yield session_
    clear_scratch(session_)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(i, t, g, "s", 0, 1, 2, "c", 3) for i, t, g in HARD], CLASHING)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
