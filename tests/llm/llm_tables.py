"""Tables and comparison shared by the tests here."""

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs, with columns whose names clash."""
    def build(*rows):
        return spark.createDataFrame(
            [(d, t, "en", "src", None, "x", 1) for d, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, at int")
    return build


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)
