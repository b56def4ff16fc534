"""Operator 3: targets by the rule, draws without favour, the same each time."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing, queries
from tests.llm.conftest import odd_rows


def targets(sizes: dict, weights=(5, 2, 1), limit=3) -> dict:
    """Targets by repeated sharing: sources that reach their limit stop and the excess is shared again."""
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] >= limit * sizes[s]]
        if not above or len(above) == len(open_):
            return stopped | share
        stopped |= {s: limit * sizes[s] for s in above}


def check(rows: list, words: dict, source: dict) -> None:
    sizes: dict = defaultdict(int)
    for i, n in words.items():
        sizes[source[i]] += n
    expected = targets(sizes)
    taken: Counter = Counter()
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(expected[source[r["doc_id"]]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(200, 0.02 * t), (s, taken[s], t)


def test_mix_of_documents(spark, sf_dir, documents, texts):
    rows = queries.op3_mixing(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    check(rows, {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}, source)
    again = queries.op3_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_targets_of_unequal_sources(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for source, count in (("a", 5), ("b", 400), ("c", 300), (None, 40), ("d", 1)):
        for _ in range(count):
            rows.append((n, " ".join(["w"] * int(rng.integers(1, 120))), source))
            n += 1
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_report(table).withColumnRenamed("id", "doc_id").collect()
    check(found, {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows})


def test_odd_rows(odd, empty):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["id"] in (4, 5, 6)} == {0}
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0 and mixing.mixed_blocks(empty).count() == 0


def test_mixed_documents_hold_what_is_taken(odd):
    taken: Counter = Counter()
    for r in mixing.mix_report(odd).collect():
        taken[r["id"]] += r["taken"]
    mixed = mixing.mixed_documents(odd)
    assert mixed.schema == odd.schema
    rows, words = mixed.collect(), Counter()
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        words[r["doc_id"]] += len(own)
        assert r["n_chars"] == len(r["text"])
        assert set(own) <= set(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] if r["doc_id"] is not None else texts[1]))
    assert {i: n for i, n in taken.items() if n} == dict(words)
    blocks = Counter()
    for r in mixing.mixed_blocks(odd).collect():
        blocks[r["source"]] += len(r["text"].split())
    by_source = Counter()
    for r in rows:
        by_source[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert blocks == by_source


def test_permutations():
    for n in (1, 2, 3, 100, 1000):
        found = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 7, np.uint64))
        assert sorted(found.tolist()) == list(range(n))
