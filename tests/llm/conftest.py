"""Small tables with awkward rows, and the given small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from tabmeld.llm.queries import prepare

SF_DIR = "/root/testdata/sf0.001"

AWKWARD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns whose names operators might use themselves.
        T.StructField("TEXT", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("_key", T.StringType()),
        T.StructField("_row", T.StringType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def sentence(begin: int, words: int) -> str:
    return " ".join(f"word{begin + i}" for i in range(words))


def awkward_rows() -> list[tuple]:
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t \n", "en", "b"),
        (4, "one", "en", None),
        (4, "one", "en", None),
        (5, sentence(0, 60), None, "b"),
        (6, sentence(0, 60), "de", "b"),
        (7, sentence(0, 60).replace("word30", "other"), "de", "b"),
        (None, sentence(100, 30), "fr", "c"),
        (None, None, None, None),
        (8, "x" * 20000, "en", "a"),
        (9, (sentence(500, 40) + "\n") * 400, "en", "a"),
        (10, "Ünïcode 文字 \U0001f600 text with separators", "en", "a"),
        (11, "5" * 5000, "en", "b"),
        (12, "| ### $$$ |" * 30, "en", "b"),
    ]
    return [
        (i, text, lang, source, None if text is None else len(text), "t", "k", 0.5, 3, 7, "k", "r", True)
        for i, text, lang, source in texts
    ]


@pytest.fixture(scope="session")
def ready(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def awkward(ready):
    return ready.createDataFrame(awkward_rows(), AWKWARD)


@pytest.fixture(scope="session")
def empty(ready):
    return ready.createDataFrame([], AWKWARD)


@pytest.fixture(scope="session")
def documents(ready):
    return ready.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict[int, str]:
    return {row.doc_id: row.text for row in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def run(ready):
    """Rows of a registered query over the small tables, by doc_id."""
    from tabmeld.llm.queries import QUERIES

    done: dict[str, list[Row]] = {}

    def rows(name: str) -> list[Row]:
        if name not in done:
            done[name] = QUERIES[name](ready, SF_DIR).collect()
        return done[name]

    return rows
