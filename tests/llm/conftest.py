import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, d string, ids string, kept string, fingerprint string, row_key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text[, source]) rows, with columns whose names operators use themselves."""

    def make(rows):
        rows = [(*r, "src")[:3] if len(r) < 3 else r for r in rows]
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "spans", "d", "ids", "kept", "fp", "key") for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and blank texts, repeated rows, equal texts, and a very long text."""
    long = " ".join(f"word{k % 997}" for k in range(30_000)) + " a@b.cd " + "1" * 20_000 + "x" * 20_000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no id here at all", "b"), (4, "same text twice", "b"), (4, "same text twice", "b"), (5, "same text twice", None), (6, long, "c"), (7, "<|endoftext|> ünï 漢字 \x00", "c")]
    return docs_of(rows)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts(spark, folder):
    """The small documents as (id, text) pairs."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
