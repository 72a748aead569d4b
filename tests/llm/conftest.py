import pytest

#: The columns of documents, two that clash with what operators add, and one to carry along.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, FP string, extra string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, lang="en", source="s", ids=None):
        data = [(k if ids is None else ids[k], t, lang, source, None if t is None else len(t), 0, "x", "y") for k, t in enumerate(texts)]
        return spark.createDataFrame(data, DOCS)

    return make


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    """Write a DataFrame as table ``name`` of a new directory."""

    def write(**named):
        d = tmp_path_factory.mktemp("sf")
        for name, df in named.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return write
