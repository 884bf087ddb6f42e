"""Tables and fixtures of the operator tests: odd tables that every operator has to take."""

import pyarrow.parquet as pq
import pytest

#: Columns whose names the operators use inside.
CLASH = ["h", "t", "row", "key", "part", "names", "fp", "shard", "band", "raw", "ids", "spans", "r", "c", "kept", "component_id"]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, very long texts."""
    word = "alpha beta gamma delta epsilon zeta eta theta "
    return [
        (1, "one two three four five six seven", "en", "a"),
        (1, "one two three four five six seven", "en", "a"),
        (2, None, None, None),
        (3, "", "en", None),
        (4, " \t\n\x0b\x0c\r ", None, "a"),
        (None, "one two three four five six seven", "en", "a"),
        (None, None, None, None),
        (5, "é" * 300 + " ñandú 日本語 😀 Σίσυφος", "fr", "b"),
        (6, word * 20_000, "en", "a"),
        (7, word * 20_000, "en", "a"),
        (8, "x" * 200_000, "en", "b"),
        (9, "a@" * 5000 + "+1" * 5000 + "1." * 5000 + "9 " * 5000, "en", "b"),
        (10, "one  two\tthree four five six\nseven", "en", "a"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def clashing(df):
    return df.selectExpr("*", *[f"'extra' AS {c}" for c in CLASH])


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text, lang, source) rows of the supplied documents."""
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]


@pytest.fixture(scope="session")
def odd(spark):
    return clashing(frame(spark, odd_rows()))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
