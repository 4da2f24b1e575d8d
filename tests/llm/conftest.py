import pytest
from made_texts import prose

@pytest.fixture(scope="session")
def texts():
    """Ids to texts: nulls, empty, short, copies, near copies, shared passages, one long text."""
    base, passage = prose(1, 120), prose(2, 60)
    rows = {0: None, 1: "", 2: "one two", 3: "one two", 4: "   \t\n", 5: base, 6: base, 7: base.upper(), 8: "Ünï\x00cödé " * 3}
    for k in range(10, 22):
        words = base.split()
        words[(k * 7) % 120] = f"changed{k}"
        rows[k] = " ".join(words)
    for k in range(30, 38):
        rows[k] = prose(k, 40) + " " + passage + " " + prose(k + 100, 30)
    rows[40] = prose(40, 9000)
    rows[41] = "na " * 4000
    rows[42] = "x" * 5000
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those rows as ``documents`` with extra columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", len(t or ""), "own", i) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, component long").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
