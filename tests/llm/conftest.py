import pytest

CLASH = "n_words", "score", "items", "ids", "component", "id", "key", "word", "gone", "also"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)
LINE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again today"


def rows_of(texts, first=0):
    return [(i, t, "en", "s", len(t) if t is not None else None, *["x"] * len(CLASH)) for i, t in enumerate(texts, first)]


def odd_texts():
    """Null, empty, blank, short, repeated, very long and non-ASCII texts."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [None, "", "  \n\t ", "one", "ONE", LINE, LINE, LINE.upper(), long, "日本語 Ünïcödé ﬁ \x00 1234", "a\n\nb\r\n" + LINE, "🙂 " * 300]


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows, one of them twice, one without an id, and clashing extra columns."""
    rows = rows_of(odd_texts())
    rows += [rows[5], (None, LINE, None, None, 3, *[None] * len(CLASH)), (3, "another text of the same id", "fr", "s", 1, *["y"] * len(CLASH))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
