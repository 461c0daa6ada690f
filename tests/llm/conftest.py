"""Small documents tables that every operator gets in its tests."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """rows: (doc_id, text); ``extra``: DDL of clashing columns, filled with nulls."""
    data = [(d, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    for column in filter(None, extra.split(",")):
        name, kind = column.split()
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


#: Nulls in any column, empty and blank texts, repeated rows and ids, a long text.
ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "one two three four five six"), (None, None),
       (4, "one two three four five six"), (4, "one two three four five six"), (4, "another text of the same id"),
       (5, "word " * 30_000), (6, "x" * 100_000), (7, "\n" * 500), (8, "a\x00b é日本 \U0001F600 ｆ")]


@pytest.fixture()
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture()
def nothing(spark):
    return documents(spark, [])
