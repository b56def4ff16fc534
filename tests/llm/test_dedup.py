"""Operators 9, 5 and 7 against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, embdedup, exact, neardup, queries, shared
from tidemark.llm.shared import shared_dir
from tests.llm.conftest import odd_rows


def sets_of(text: str | None) -> frozenset:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


class Forest:
    def __init__(self):
        self.up: dict = {}

    def top(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = sorted((self.top(x), self.top(y)))
        self.up[b] = a


def near_brute(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    forest, held, sets = Forest(), defaultdict(list), [sets_of(t) for _, t in rows]
    for n, s in enumerate(sets):
        for shingle in s:
            held[shingle].append(n)
    common: Counter = Counter()
    for members in held.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                common[a, b] += 1
    for i, _ in rows:
        forest.top(i)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            forest.join(rows[a][0], rows[b][0])
    return {i: forest.top(i) for i, _ in rows}


def test_exact_matches_brute_force(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in queries.op9_exact_dedup(spark, sf_dir).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    assert len(found) == len(texts)
    for i, t in texts.items():
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_exact_names_blocks(odd, block):
    rows = exact.exact_groups(odd, block_bytes=block if block > 1 else 64).collect()
    by = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert by[1, 2, 3, False] == 1 and by[2, 2, 3, True] == 1 and by[None, 2, 3, False] == 1
    assert by[3, 3, 2, True] == 1 and by[3, 3, 2, False] == 1
    assert by[5, 5, 3, True] == 1 and by[4, 5, 3, False] == 1 and by[None, 5, 3, False] == 1
    assert by[9, 9, 1, True] == 1 and by[10, 10, 1, True] == 1
    assert len(rows) == len(odd_rows())


def test_exact_drop_keeps_columns(odd, empty):
    kept = exact.drop_exact(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == [2, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert {r["_id"] for r in rows if r["doc_id"] == 9} == {"y"}
    assert exact.drop_exact(empty).count() == 0 and exact.exact_groups(empty).count() == 0


@pytest.mark.parametrize("held", [16, 16_384])
def test_exact_sends_a_hot_block_once_a_task(spark, monkeypatch, held):
    """A third of all rows is one text and all rows begin with one block: the tasks' tables, however small, keep groups right."""
    monkeypatch.setattr(exact, "HELD_BLOCKS", held)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        head = "h" * 64
        rows = [(i, head + ("same" if i % 3 == 0 else f"own {i // 2}")) for i in range(600)]
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        found = exact.exact_groups(table, block_bytes=64).collect()
        assert {r["id"]: (r["keep_id"], r["group_size"]) for r in found} == {i: (max(groups[t]), len(groups[t])) for i, t in rows}
        pieces = table.withColumn("given", F.lit(None).cast("long")).mapInArrow(exact._cut(64), exact._PIECES)
        sent = Counter(bytes(r["block"]) for r in pieces.where("block is not null").collect())
        assert sent[head.encode()] == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_near_matches_brute_force(spark, sf_dir, texts):
    rows = sorted(texts.items())
    expected = near_brute(rows)
    found = queries.op5_minhash(spark, sf_dir).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert all(r["n_shingles"] == len(sets_of(texts[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("block", [24, 2048])
def test_near_large_group(spark, monkeypatch, block):
    """A bucket of hundreds of near copies in chains, with pivots that do not link to all."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, base = [], [f"w{k}" for k in range(60)]
    for i in range(400):
        words = list(base)
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = f"v{i}"
        rows.append((i, " ".join(words)))
    for i in range(400, 430):
        base = base[1:] + [f"n{i}"]
        rows.append((i, " ".join(base)))
    found = {r["id"]: r["component_id"] for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == near_brute(rows)


def test_near_odd_rows(odd, empty):
    found = neardup.near_groups(odd).collect()
    assert len(found) == len(odd_rows())
    by = Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    assert by[1, 16, 1, True] == 1 and by[2, 16, 1, False] == 1 and by[3, 16, 1, False] == 2
    assert by[4, 0, 4, True] == by[5, 0, 5, True] == by[6, 0, 6, True] == 1
    assert by[7, 1, 7, True] == 1 and by[8, 1, 8, True] == 1
    assert {r["component_id"] for r in found if r["id"] in (9, 10)} == {9}
    assert all(r["component_id"] is None and r["kept"] for r in found if r["id"] is None)
    assert neardup.near_groups(empty).count() == 0 and neardup.drop_near(empty).count() == 0
    kept = neardup.drop_near(odd)
    assert kept.schema == odd.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 4, 5, 6, 7, 8, 9, 11, 12]


def test_near_rows_that_repeat_an_id(spark):
    """Rows with one id and different texts both stay; of equal and near ones the smallest id stays."""
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(5, base), (5, "quite another text with more than five words in it"), (5, base), (9, base + " more"), (None, base), (3, None), (3, "")]
    kept = neardup.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept) == [(0, base[:5]), (3, ""), (3, ""), (5, "quite"), (5, base[:5])]


def test_third_of_all_rows_is_one_text(spark):
    """Exact groups and the mix with one text, id and source that hold a third of all rows."""
    same = "the same words again and again in every copy"
    rows = [(7, same, "hot")] * 400 + [(100 + i, f"text {i} " + "word " * (i % 9), f"s{i % 4}") for i in range(800)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    groups = exact.exact_groups(table).where("id = 7").collect()
    assert len(groups) == 400 and {(r["keep_id"], r["group_size"]) for r in groups} == {(7, 400)} and sum(r["kept"] for r in groups) == 1
    kept = exact.drop_exact(table).collect()
    assert len(kept) == len({t for _, t, _ in rows})
    assert neardup.near_groups(table).where("id = 7 and component_id = 7").count() == 400


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.75, 0.9):
        ones = []
        for _ in range(40):
            same = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            rest = round(300 * (1 - share) / share)
            one, two = (np.unique(np.concatenate([same, rng.integers(0, 1 << 63, rest).astype(np.uint64)])) for _ in range(2))
            a, b = (neardup.odd_sketches(neardup.minhashes(s)[None]) for s in (one, two))
            ones.append(int(np.unpackbits((a ^ b).view(np.uint8)).sum()))
        m = neardup.SAMPLES
        expected = neardup.SKETCH_BITS / 2 * (1 - math.exp(-4 * m * (1 - share) / neardup.SKETCH_BITS))
        assert abs(np.mean(ones) - expected) < 6
        assert max(ones) <= neardup.most_ones(neardup.SKETCH_FLOOR)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: forest.top(i) for pair in links for i in pair if any(p[0] != p[1] for p in links if i in p)}


def vectors_brute(rows):
    usable = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            usable[n] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, forest = Counter(), Forest()
    for n, (i, _, _) in enumerate(rows):
        forest.top(i)
    keys = sorted(usable)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                forest.join(rows[a][0], rows[b][0])
    return links, forest


def test_vectors_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    links, forest = vectors_brute(rows)
    tops = {i: forest.top(i) for i, _, _ in rows}
    found = {r["vec_id"]: r for r in queries.op7_lattice(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["n_links"] <= links[n] and found[i]["component_id"] >= tops[i] for n, (i, _, _) in enumerate(rows))
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * sum(links.values())
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items()) and sum(r["component_id"] == tops[i] for i, r in found.items()) >= 0.99 * len(rows)


@pytest.mark.parametrize("block", [40, 4096])
def test_vectors_recall_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    monkeypatch.setattr(embdedup, "ROWS", 16)
    rng = np.random.default_rng(11)
    rows = []
    for c in range(20):
        centre = rng.standard_normal(64)
        for _ in range(30):
            v = centre + rng.standard_normal(64) * np.linalg.norm(centre) / 8 * rng.uniform(0.1, 0.3)
            rows.append((len(rows), [float(x) for x in v], c % 3))
    same = rows[0][1]
    rows += [(1000 + i, same, 0) for i in range(600)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 64, 0), (2003, [float("nan"), *same[1:]], 0), (2004, [None, *same[1:]], 0), (2005, same, None), (2006, [float("inf"), *same[1:]], 0), (2007, same[:32], 0), (2008, [x * 1e200 for x in same], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("cells", F.lit("x"))
    links, forest = vectors_brute([(i, [x / 1e200 for x in v] if i == 2008 else v, label) for i, v, label in rows])
    found = {r["vec_id"]: r for r in embdedup.near_vectors(table).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["n_links"] <= links[n] for n, (i, _, _) in enumerate(rows))
    assert sum(r["n_links"] for r in found.values()) >= 0.999 * sum(links.values())
    tops = {i: forest.top(i) for i, _, _ in rows}
    assert all(r["component_id"] >= tops[i] and r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert sum(r["component_id"] == tops[i] for i, r in found.items()) >= 0.995 * len(rows)
    assert found[1000]["n_links"] >= 600 and found[2008]["component_id"] == found[1000]["component_id"]
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert embdedup.near_vectors(table.limit(0)).count() == 0
    nulls = embdedup.near_vectors(spark.createDataFrame([(None, same, 1), (None, same, 1), (5, same, 1)], table.select("vec_id", "embedding", "label").schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in nulls) == [(0, 0, 0), (0, 0, 0), (5, 0, 5)]


def test_vectors_recall_just_above_the_threshold(spark):
    """Pairs of distinct vectors, each alone with its partner, at cosines of 0.93 to 0.95."""
    rng = np.random.default_rng(17)
    n = 2000
    one, two = (rng.standard_normal((n, 64)) for _ in range(2))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two -= (two * one).sum(axis=1, keepdims=True) * one
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, (n, 1))
    two = cosine * one + np.sqrt(1 - cosine**2) * two
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([one, two]))]
    found = {r["vec_id"]: r for r in embdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(found) == 2 * n
    linked = sum(found[n + i]["component_id"] == found[i]["component_id"] for i in range(n))
    assert linked >= 0.995 * n, linked


def test_vectors_that_share_an_id(spark):
    """Different vectors of one id have links of their own."""
    one, other = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    table = spark.createDataFrame([(1, one, "a"), (1, other, "a"), (2, one, "a"), (3, [0.0] * 6 + [0.1, 1.0], "a"), (4, other, "b")], "vec_id long, embedding array<double>, label string")
    rows = Counter(tuple(r) for r in embdedup.near_vectors(table).collect())
    assert rows == {(1, 1, 1, True): 2, (2, 1, 1, False): 1, (3, 1, 1, False): 1, (4, 0, 4, True): 1}


@pytest.mark.parametrize("block", [8, 4096])
def test_vectors_in_chains(spark, monkeypatch, block):
    """Chains in which each vector is linked to the next alone, ids in random order, are one component each."""
    monkeypatch.setattr(embdedup, "BLOCK", block)
    monkeypatch.setattr(embdedup, "ROWS", 3)
    rng = np.random.default_rng(3)
    ids, rows, chains = rng.permutation(60 * 9).tolist(), [], []
    for _ in range(60):
        turn = np.linalg.qr(rng.standard_normal((16, 2)))[0]
        chains.append([ids.pop() for _ in range(9)])
        angles = np.radians(13.0 * np.arange(9))
        for i, v in zip(chains[-1], np.stack([np.cos(angles), np.sin(angles)], axis=1) @ turn.T, strict=True):
            rows.append((i, v.tolist(), len(chains)))
    found = {r["vec_id"]: r for r in embdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, forest = vectors_brute(rows)
    assert all(found[i]["n_links"] <= links[n] for n, (i, _, _) in enumerate(rows))
    if sum(r["n_links"] for r in found.values()) == sum(links.values()):  # none missed: then components are exact
        assert {i: r["component_id"] for i, r in found.items()} == {i: forest.top(i) for i, _, _ in rows}
    full = [c for c in chains if sum(found[i]["n_links"] for i in c) == 2 * 8]
    assert len(full) > 40 and all({found[i]["component_id"] for i in c} == {min(c)} for c in full)


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (200, 8))
    near = embdedup.nearest_e8(x)
    others = near[:, None, :] + embdedup.ROOTS
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None, :] - others) ** 2).sum(2) + 1e-9).all()
    assert len(embdedup.ROOTS) == 240 and np.allclose((embdedup.ROOTS**2).sum(1), 2)


def test_shared_helpers(spark, odd):
    assert shared.fresh(odd, "id", "ID", "new") == ["__id", "___ID", "new"]
    hashes = odd.select("doc_id", shared.row_hash(odd).alias("h")).collect()
    assert len({r["h"] for r in hashes if r["doc_id"] == 3}) == 1 and len({r["h"] for r in hashes}) == len(odd_rows()) - 1
    table = spark.range(1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("n"), F.lit(2).cast("long").alias("two"))
    found = shared.running_sums(table, ["k", "n"], {"n": "before", "two": "place"}).orderBy("k", "n").collect()
    total = 0
    for at, r in enumerate(found):
        assert (r["before"], r["place"]) == (total, 2 * at)
        total += r["n"]
    assert shared.running_sums(table.limit(0), ["k"], {"n": "before"}).count() == 0
    with shared.scratch(spark) as folder:
        inside = shared.written(table, "kept")
        assert inside.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(folder.split("file:")[-1].lstrip("/"))
    with pytest.raises(Exception):
        inside.count()


def test_tables_lie_in_the_checkpoint_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark).startswith(named.rstrip("/"))
