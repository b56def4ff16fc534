"""Small tables with everything that can be odd about documents."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

LONG = "the quick brown fox jumps over the lazy dog near the river bank \n" * 6_000

#: doc_id, text, lang, source, n_chars and columns whose names operators could want for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, _id string, size long, rank int, label string, key int, _copy int, _text string, _slot int, mark int, _source string"


def odd_rows() -> list[tuple]:
    extra = ("x", "y", 1, 2, "z", 3, 4, "w", 5, 6, "v")
    none = (None,) * len(extra)
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    return [
        (1, same, "en", "a", len(same), *extra),
        (2, same, "en", "a", len(same), *none),
        (3, same.upper(), "en", "b", len(same), *extra),
        (3, same.upper(), "en", "b", len(same), *extra),
        (4, "", "en", "b", 0, *extra),
        (5, None, None, None, None, *none),
        (6, "  \t\n ", "en", "", 6, *extra),
        (7, "one", "en", "c", 3, *extra),
        (8, "one two", "en", "c", 7, *extra),
        (9, LONG, "en", "a", len(LONG), *extra),
        (10, LONG + "x", "en", None, len(LONG) + 1, *none),
        (None, same, "en", "a", len(same), *extra),
        (None, None, None, None, None, *none),
        (11, "naïve Ünïcode ☃ 日本語 text \U0001f600 with marks", "de", "ä", 40, *extra),
        (12, "write to Jo@example.org or +49 (30) 1234-5678, host 10.0.0.1, card 4111 1111 1111 1111", "en", "a", 80, *extra),
    ]


@pytest.fixture(scope="session")
def odd(spark) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
