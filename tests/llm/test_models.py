"""Operators 1, 4 and 6: held-out accuracy, and spans against plain patterns."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import neardup, pii, quality, queries, textscan, toxicity
from tidemark.llm.textscan import column_bytes, word_hashes, word_spans
from tests.llm.conftest import odd_rows


def accuracy(scored, labels: dict) -> tuple[float, float]:
    """Area under the curve and accuracy on held-out labelled rows."""
    rows = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad)
    return wins / max(1, len(good) * len(bad)), sum(p == y for _, p, y in rows) / len(rows)


def test_quality_on_held_out_rows(spark, sf_dir, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None}
    rows = queries.op1_quality(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    curve, right = accuracy(rows, labels)
    assert curve > 0.85 and right > 0.8, (curve, right)


def test_toxicity_on_held_out_rows(spark, sf_dir, texts):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["toxic"] is not None}
    rows = queries.op6_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    curve, right = accuracy(rows, labels)
    assert curve > 0.85 and right > 0.85, (curve, right)


def test_models_take_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (7, 0, 1), (8, 1, 0), (9, 0, 1), (10, 1, 0), (2, None, None), (None, 1, 1), (12, 1, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")
    for made in (quality.quality, toxicity.toxicity):
        rows = made(odd, labels).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
        assert made(empty, labels).count() == 0
        assert {r["score"] for r in made(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd, labels)
    assert kept.schema == odd.schema
    good = {r["doc_id"] for r in quality.quality(odd, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == good
    assert quality.keep_good(empty, labels).count() == 0


def lopsided(spark, good_share: float, n: int = 1400):
    """Documents alike for every label's share: plain lines, more or fewer of them junk, and labels that lean with the junk."""
    rng = np.random.default_rng(3)
    documents, labels = [], []
    for i in range(n):
        junk = int(rng.integers(0, 9))
        lines = ["The river ran slowly past the old mill that day, and nobody spoke.", "$$ CLICK HERE || BUY NOW!!! || 100% FREE || $$$ ###"]
        documents.append((i, "\n".join(lines[1 if k < junk else 0] for k in rng.permutation(8))))
        odds = good_share / (1 - good_share) * np.exp(0.5 * (4 - junk))
        labels.append((i, int(rng.random() < odds / (1 + odds))))
    return spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_scores_do_not_depend_on_the_sample(spark, monkeypatch):
    """A sample with as many good as bad documents gives the probabilities of the labels' real shares."""
    documents, labels = lopsided(spark, 6 / 7)
    scores = {}
    for size in (4_000, 200):
        monkeypatch.setattr(quality, "SAMPLE", size)
        scores[size] = {r["doc_id"]: r["score"] for r in quality.quality(documents, labels).collect()}
    whole, part = (np.array([scores[s][i] for i in sorted(scores[s])]) for s in (4_000, 200))
    assert abs(whole - part).mean() < 0.06 and abs(whole.mean() - part.mean()) < 0.04, (abs(whole - part).mean(), whole.mean(), part.mean())


def test_toxicity_scores_do_not_depend_on_the_sample(spark, monkeypatch):
    """A sample with as many toxic as clean documents gives the probabilities of the labels' real shares."""
    documents, labels = lopsided(spark, 1 / 9, 3000)
    labels = labels.withColumnRenamed("quality", "toxic")
    scores = {}
    for size in (12_000, 600):
        monkeypatch.setattr(toxicity, "SAMPLE", size)
        scores[size] = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, labels).collect()}
    whole, part = (np.array([scores[s][i] for i in sorted(scores[s])]) for s in (12_000, 600))
    assert abs(whole - part).mean() < 0.09 and abs(whole.mean() - part.mean()) < 0.05, (abs(whole - part).mean(), whole.mean(), part.mean())


def lexicon_of(*entries: tuple[str, int]) -> np.ndarray:
    """Keys of words (0), of their first five (1) or first four bytes (2)."""
    keys = [toxicity._keys(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[k, 0] for w, k in entries]
    return np.sort(np.array(keys, np.uint64))


def plain_features(text: str) -> list[float]:
    """The dense features of an ASCII text by loops, for the lexicon idiot, stupi- and hate-."""
    raw = re.findall(r"[A-Za-z0-9@$]+", text)
    words = ["".join(toxicity.LOOK_ALIKES.get(c, c) for c in w).lower() for w in raw]
    n, size = max(1, len(words)), max(1, len(text))
    held = [w == "idiot" for w in words]
    stems = [h or (len(w) > 5 and w[:5] == "stupi") or (len(w) > 4 and w[:4] == "hate") for h, w in zip(held, words, strict=True)]
    person = [w in toxicity.SECOND_PERSON for w in words]
    near = [s and any(person[max(0, i - toxicity.REACH) : i + toxicity.REACH + 1]) for i, s in enumerate(stems)]
    letters = [any(c.isalpha() for c in w) for w in raw]
    obfuscated = [l and any(c in toxicity.LOOK_ALIKES for c in w) for l, w in zip(letters, raw, strict=True)]
    capitals = [w.isalpha() and w.isupper() and len(w) > 1 for w in raw]
    repeated = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    punctuation = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    return [np.log1p(len(words)), sum(held) / n, sum(held), sum(stems) / n, sum(stems), sum(near) / n, sum(person) / n, sum(c.isupper() for c in text) / size, sum(capitals) / n, punctuation / size, text.count("!") / size, sum(obfuscated) / n, sum(repeated) / n]


def test_dense_features_against_loops():
    rng = np.random.default_rng(13)
    words = ["you", "YOU", "1d10t", "idiot", "Stupidly", "stupi", "hated", "hate", "the", "mill", "$ay", "42", "ur!!", "a-b", "...", "walk", "WALK"]
    texts = ["", "!!!", "idiot", *(" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(60))]
    found = toxicity.dense_features(pa.array([*texts, None]), lexicon_of(("idiot", 0), ("stupid", 1), ("hated", 2)))
    assert found.shape == (len(texts) + 1, len(toxicity.FEATURES)) and not found[-1].any()
    for text, row in zip(texts, found, strict=False):
        assert np.allclose(row, plain_features(text)), (text, dict(zip(toxicity.FEATURES, zip(row, plain_features(text), strict=True), strict=True)))


def test_lexicon_holds_what_toxic_documents_hold(spark):
    rows = [(f"some plain words number{i} gronk", 1) for i in range(30)] + [(f"some plain words number{i} mill", 0) for i in range(60)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label long"))
    assert np.isin(lexicon_of(("gronk", 0)), lexicon).all()
    assert not np.isin(lexicon_of(("plain", 0), ("mill", 0), ("words", 2)), lexicon).any()
    assert len(toxicity.learn_lexicon(spark.createDataFrame(rows[:5], "text string, label long"))) == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(6)
    firsts = np.array([0, 3, 3, 4, 9])
    unary, transition = rng.standard_normal((9, 2)), rng.standard_normal((2, 2))
    found, pairs = quality.forward_backward(unary, transition, firsts)
    expected_pairs = np.zeros((2, 2))
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        total, marginal, joint = 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(sum(unary[a + i, y] for i, y in enumerate(labels)) + sum(transition[x, y] for x, y in itertools.pairwise(labels)))
            total += p
            for i, y in enumerate(labels):
                marginal[i, y] += p
            for x, y in itertools.pairwise(labels):
                joint[x, y] += p
        if b > a:
            assert np.allclose(found[a:b], marginal / total)
            expected_pairs += joint / total
    assert np.allclose(pairs, expected_pairs)


def test_line_labels_sum_to_the_score(spark, sf_dir, documents):
    model = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lines = quality.line_labels(documents, model).groupBy("doc_id").agg((F.sum(F.col("good") * F.col("n_bytes")) / F.sum("n_bytes")).alias("q"))
    scores = {r["doc_id"]: r["score"] for r in quality.scored(documents, model).collect()}
    for r in lines.collect():
        assert abs(scores[r["doc_id"]] - model.score(np.array([r["q"]]))[0]) < 1e-9


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_plain_patterns(spark, sf_dir, texts):
    rows = queries.op4_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert set(joined.split(",")) - {""} <= {":".join(s) for s in spans}
        order = [(list(PATTERNS).index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order)


def test_base_spans_of_any_text():
    rng = np.random.default_rng(8)
    letters = np.array(list("a@.-+0123456789  ()%_1é\n"))
    for _ in range(4000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 60))))
        assert pii.base_spans(text)[0] == plain(text), text


def test_field_adds_spans_that_patterns_miss(documents, spark):
    model = pii.train(documents)
    text = "call it 4465758382889437 4465758382889437 today"
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find(table, model).first()
    assert plain(text) == [] and row["n_card"] == 0 and row["spans"] == "card:8:24,card:25:41"


def field_of(skip: float, transition=None) -> pii.SkipChain:
    k = len(pii.LABELS)
    return pii.SkipChain(np.zeros((3 * len(pii.FEATURES), k)), np.zeros((k, k)) if transition is None else transition, skip)


def enumerated(field: pii.SkipChain, local, linked, hub, hubs) -> np.ndarray:
    """Marginals of all labels by summing over every assignment of labels and hub states."""
    n, k = local.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        score = sum(local[i, y] for i, y in enumerate(labels)) + sum(field.transition[labels[i], labels[i + 1]] for i in range(n - 1) if linked[i])
        p = np.exp(score)
        for h in range(hubs):
            p *= sum(np.exp(field.skip * sum(pii.KIND_OF[labels[i]] == state for i in range(n) if hub[i] == h)) for state in range(-1, len(pii.KINDS)))
        for i, y in enumerate(labels):
            out[i, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_messages_are_exact_without_loops():
    rng = np.random.default_rng(9)
    k = len(pii.LABELS)
    for linked, hub, hubs in (([1, 1, 1, 0], [-1] * 4, 0), ([0, 0, 0, 0], [0, 0, 0, 0], 1), ([1, 0, 0, 0], [-1, 0, 0, 0], 1), ([0, 1, 0, 0], [0, 0, 1, 1], 2)):
        field = field_of(1.3, rng.standard_normal((k, k)))
        local = rng.standard_normal((4, k)) * 2
        linked, hub = np.array(linked, bool), np.array(hub)
        assert np.allclose(field.beliefs(local, linked, hub, hubs), enumerated(field, local, linked, hub, hubs), atol=1e-5)


def test_messages_with_loops_come_near():
    rng = np.random.default_rng(10)
    field = field_of(0.8, rng.standard_normal((len(pii.LABELS),) * 2) * 0.5)
    local = rng.standard_normal((4, len(pii.LABELS)))
    linked, hub = np.array([1, 1, 1, 0], bool), np.array([0, 1, 0, 1])
    assert np.abs(field.beliefs(local, linked, hub, 2) - enumerated(field, local, linked, hub, 2)).max() < 0.05


def test_messages_settle_on_texts_that_swing():
    """Few values again and again close many loops; the rounds stay bounded and do not grow with the text."""
    rng = np.random.default_rng(11)
    field = pii.fit(["mail jo@example.org or call +49 30 1234 5678, host 10.0.0.1, card 4111 1111 1111 1111"] * 3)
    pool = ["jo@example.org", "10.0.0.1", "4111", "1111", "+49", "30", "1234", "x7", "word", "55512345"]
    for n in (500, 2_000, 8_000, 100_000):
        field.spans(" ".join(rng.choice(pool, n)))
        assert field.rounds < 200, n


def test_memory_of_long_texts():
    """Scans of one text of 20 MB take arrays for its words and none of eight bytes for each byte."""
    import tracemalloc

    text = pa.array(["a quick Brown fox! 42 | you #1\n" * (20_000_000 // 31)])
    for scan in (lambda c: quality.line_features(*column_bytes(c)), lambda c: toxicity.dense_features(c, np.zeros(0, np.uint64)), lambda c: list(neardup.shingle_sets(c))):
        tracemalloc.start()
        scan(text)
        assert tracemalloc.get_traced_memory()[1] < 30 * 20_000_000  # words of four bytes; longer ones take less
        tracemalloc.stop()


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    data, offsets = column_bytes(pa.array(["Some words, ONE " + "long" * 40 + " here", "", "x y z " * 30]))
    starts, ends, _ = word_spans(data, offsets)
    whole = word_hashes(data, starts, ends)
    for size in (1, 7, 64):
        monkeypatch.setattr(textscan, "CHUNK_BYTES", size)
        assert (word_hashes(data, starts, ends) == whole).all()


def test_repeated_tokens_share_a_hub():
    """A token that looks like nothing takes the label of its like elsewhere in the text, however short or far away."""
    tokens = pii.Tokens("id 41111111 then many words and id 41111111 again, 10.0.0.1 and 10.0.0.1, 7 alone")
    assert tokens.hubs == 2 and tokens.hub.tolist() == [0, 0, 1, 1, -1]
    n = 30
    tokens = pii.Tokens(" then ".join(["41111111"] * n))
    assert tokens.hubs == 1 and not tokens.linked.any()
    local = np.zeros((n, len(pii.LABELS)))
    local[0, 3] = 9.0
    beliefs = field_of(6.0).beliefs(local, tokens.linked, tokens.hub, tokens.hubs)
    assert (beliefs[:, [3, 5]].sum(axis=1) > 0.8).all()


def test_potentials_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("a@.1 2,\n"), 400))
    tokens = pii.Tokens(text)
    unary = rng.standard_normal((3 * len(pii.FEATURES), len(pii.LABELS)))
    for piece in (1, 2, 7, 1000):
        monkeypatch.setattr(pii, "PIECE", piece)
        assert np.allclose(tokens.potentials(unary), tokens.features() @ unary)
    long = "x" * 500 + "@example.org"
    assert pii.Tokens(long).features()[0, pii.FEATURES.index("at_domain")] == 1


def test_field_learns_from_distinct_texts_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda texts: texts)
    own = [f"call 555-010{i}" for i in range(6)]
    documents = spark.createDataFrame([(t,) for t in own for _ in range(40)], "text string").repartition(3)
    assert len(set(pii.train(documents, sample=4))) == 4 and sorted(pii.train(documents)) == own
    long = " ".join(f"{i} word" for i in range(8_000))
    parts = pii.train(spark.createDataFrame([(long,)], "text string"))
    assert "".join(sorted(parts, key=long.index)) == long and max(map(len, parts)) <= 20_000


def test_pii_odd_rows(spark, odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == len(odd_rows())
    by = {r["doc_id"]: r for r in rows}
    assert (by[5]["n_email"], by[5]["spans"]) == (0, "") and by[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (by[12]["n_email"], by[12]["n_ip"], by[12]["n_card"], by[12]["n_phone"]) == (1, 1, 1, 1)
    assert pii.find(empty).count() == 0
