import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "extra string, doc_id long, text string, lang string, source string, n_chars long, h long, key string, lang_pred string, score double, _th long, _times int, `a.b` string, size long"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ties."""
    long = " ".join(f"word{i * i % 9973}" for i in range(60_000))
    rows = [
        ("x", 1, None, "en", "a", None), ("x", 2, "", "en", "a", 0), ("x", 3, " \n\t ", None, "b", 4), ("x", 4, long, "en", None, len(long)),
        ("x", 5, "The house of the lord is here", "en", "b", 29), ("x", 5, "The house of the lord is here", "en", "b", 29), (None, None, "The house of the lord is here", "en", "b", 29),
        ("x", None, None, None, None, None), ("x", -7, "123 456 !!", "fr", "é", 10), ("x", 8, long[: len(long) // 2], "fr", "c", 5), ("x", 9, "la maison de la mer", "fr", "", 3),
    ]
    return [(e, d, t, lang, s, n, 7, "clash", "xx", 0.5, 3, 2, "dot", 1) for e, d, t, lang, s, n in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(small):
    import duckdb

    return duckdb.sql(f"select doc_id, text, lang, source from '{small}/documents.parquet' order by doc_id").fetchall()
