"""Operator 12 against plain loops and DuckDB."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import lexical, queries

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(PATTERN.findall((text or "").translate(LOWER)))


def ranked(documents, items, top=20):
    """(item_id, rank, doc_id, score), from all documents for all items."""
    held = [(doc, found, sum(found.values())) for doc, text in documents if (found := terms(text))]
    total, df = sum(n for _, _, n in held), Counter(t for _, found, _ in held for t in found)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, found, n in held:
            m, score = 75 + 25 * n * len(held) // total, 0
            for term, q in terms(text).items():
                if tf := found[term]:
                    score += q * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[term] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scores)[:top])]
    return out


def key(row):
    return str(row[0]), row[1]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_whole_tables_against_sql(spark, sf_dir):
    tables = duckdb.connect()
    for name in ("documents", "benchmark"):
        tables.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    want = tables.execute(queries.ORACLES["op12_lexical_search"]).fetchall()
    assert collected(queries.op12_lexical_search(spark, sf_dir)) == sorted(want, key=key)


ITEMS = [(1, "The quick fox, the LAZY dog"), (2, "日本語 naïve text"), (2, "alpha one two"), (3, None), (4, "!?"), (5, "kappa Kappa lambda"), (5, "kappa Kappa lambda"), (None, "beta gamma"), (6, "absent words")]


@pytest.mark.parametrize(("block", "entries", "top"), [(200_000, 1 << 21, 20), (3, 5, 2), (1, 1, 1)])
def test_odd_rows_in_blocks_and_ranges(spark, odd, monkeypatch, block, entries, top):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    monkeypatch.setattr(lexical, "SALTS", 3)
    items = spark.createDataFrame([(*r, 1, 2) for r in ITEMS], "item_id long, text string, item int, term int")
    want = ranked([(r[0], r[1]) for r in odd_rows()], ITEMS, top)
    assert collected(lexical.search(odd, items, top)) == sorted(want, key=key)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="top"):
        lexical.search(odd, items, 0)


def test_a_third_of_all_rows_alike(spark):
    documents = [(k, "same words here" if k % 3 == 0 else f"words number {k} of many" * (k % 5)) for k in range(900)]
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(7)
    items = [(1, "same words"), (2, "number 7 of")]
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert collected(got) == sorted(ranked(documents, items), key=key)


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(1)
    for most in (1, 9, 1 << 16, 1 << 20, 1 << 40):
        keys = rng.integers(0, most, 5_000)
        assert (lexical.radix_sorted(keys) == np.argsort(keys, kind="stable")).all()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 64)
    text = "alpha, Beta gamma-delta 日本語 " * 30 + "x" * 500 + " alpha"
    vocabulary = sorted(t.encode() for t in terms(text))
    column = pa.array(["beta", text, None, ""])
    got = {}
    for a, lengths, row, term, count in lexical._matches(column, lexical.Vocabulary(vocabulary)):
        for r, t, c in zip(row, term, count):
            got.setdefault(int(a + r), {})[vocabulary[t].decode()] = int(c)
    assert got == {0: {"beta": 1}, 1: dict(terms(text))}
    assert lexical.terms_of(column)[1] == {k.encode(): v for k, v in terms(text).items()}
