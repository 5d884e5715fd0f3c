import pytest


@pytest.fixture()
def docs(spark):
    """Makes a documents table; extra columns have names that operators use within."""

    def make(rows):
        df = spark.createDataFrame([(i, t, lang) for i, t, lang in (r if len(r) == 3 else (*r, "en") for r in rows)], "doc_id long, text string, lang string")
        return df.selectExpr("*", "'x' as source", "cast(length(text) as bigint) as n_chars", "1 as k", "2 as fp", "3 as h", "4 as score")

    return make


@pytest.fixture()
def rows():
    def get(df):
        out = [tuple(r) for r in df.collect()]
        return sorted(out, key=repr)

    return get


