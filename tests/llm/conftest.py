import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*rows, extra=""):
        return spark.createDataFrame(list(rows), "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra)

    return make


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None)
