import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, words int, kept string, size int"


def document(i, text, source="a"):
    return (i, text, None, source, None if text is None else len(text), "clash", 1, "clash", 2)


@pytest.fixture(scope="session")
def table(spark):
    """Documents with columns whose names clash with those of the operators; over several partitions."""

    def make(rows):
        rows = [document(*r) for r in rows]
        return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def by_id():
    def collect(df, key="doc_id"):
        found = {}
        for r in df.collect():
            found.setdefault(r[key], []).append(r.asDict())
        return found

    return collect
