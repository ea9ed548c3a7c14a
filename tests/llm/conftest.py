import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of texts, or of whole rows."""

    def build(rows, schema=SCHEMA):
        if schema == SCHEMA:
            rows = [
                r if isinstance(r, tuple) else (i, r, "en", f"s{i % 3}", len(r or ""))
                for i, r in enumerate(rows)
            ]
        return spark.createDataFrame(rows, schema)

    return build


#: Null, empty, white space of several kinds, no word, and code points of all lengths.
ODD = [None, "", " \t\n", " ", "é ñ 日本 😀", "a", "...", "a\x0bb\x0cc", "A B A B A B", "'s 't 'RE"]
