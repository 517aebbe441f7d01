"""Documents for the operators: the smallest table, and rows that are odd in some way."""

import pytest

ODD = [
    (9001, None, "en", "src0", 0), (9002, "", None, None, None), (9003, " \n\t ", "en", "src1", 4), (9004, "One", "en", None, 3), (9005, "one", "xx", "src1", 3),
    (9006, "Two words", "en", "src2", 9), (9006, "Two words", "en", "src2", 9), (9007, "same\nsame\nsame\n" * 30, "en", "src2", 1), (None, "no id here " * 9, None, None, None),
    (9008, "x" * 40_000, "de", "src3", 1), (9009, "1234 5678 !!", "fr", "src3", 12), (9010, "ß Ünïcode 🎉 a b c", "de", "src3", 1),
    (9011, " ".join(f"w{i % 997}" for i in range(30_000)), "en", "src3", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, small):
    """With extra columns whose names the operators use themselves."""
    rows = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA))
    more = {c: "doc_id" for c in ("size", "rank", "shard", "set", "key", "kept", "n_words", "_text", "_source", "taken", "spans", "score")}
    return rows.selectExpr("*", *(f"{v} as `{k}`" for k, v in more.items()))


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
