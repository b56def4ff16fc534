"""Operators 2, 8 and 10 against the libraries and SQL whose results they give."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import bpe, placement, queries, tokencount
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def encoder() -> bpe.TextEncoder:
    with open(PATH, encoding="utf-8") as file:
        return bpe.TextEncoder(file.read())


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_digests_match_the_library(spark, sf_dir, texts, library):
    rows = queries.op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hexed(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == hexed(library.decode(ids, skip_special_tokens=False))


def test_bpe_of_every_code_point(library, encoder):
    """Alone, doubled, between letters and among marks: classes, lower case and normalisation are those of the library."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("a{0}b {0}{0} 1{0}'s", "e\u0315{0}\u0301 {0}\u0334", "\U00011935{0} q\u0323{0}"):
        texts = [shape.format(c) for c in points]
        for a in range(0, len(texts), 200_000):
            ids, offsets = encoder.encode(texts[a : a + 200_000])
            ids = ids.tolist()
            for text, found, x, y in zip(texts[a : a + 200_000], library.encode_batch(texts[a : a + 200_000], add_special_tokens=False), offsets[:-1].tolist(), offsets[1:].tolist()):
                assert ids[x:y] == found.ids, [hex(ord(c)) for c in text]


ASSIGNED = st.characters(exclude_categories=["Cn", "Cs"])


@settings(max_examples=250, deadline=None)
@given(st.text(ASSIGNED, max_size=60) | st.text(st.sampled_from("ab'S t0_.\n<|endoftx>éß日Σς\u0301\x1c\x85\U0003d000"), max_size=40) | st.text(st.sampled_from("'sterlvmd "), max_size=40))
def test_bpe_of_any_text(library, encoder, text):
    assert encoder.ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'Sé0 .") , max_size=30) | st.sampled_from(["", " ", "<|endoftext|>", "x<|startoftext|>'s", "'", "'ll"]), max_size=12))
def test_bpe_of_many_texts_at_once(library, encoder, texts):
    ids, offsets = encoder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_long_words_and_long_texts(library, encoder, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (1, 127, 128, 129, 300, 5_000)]
    for text in (words[5], " ".join(words), "日本語テキスト" * 300, "a1" * 400, "!?" * 700):
        assert encoder.ids(text) == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PART_CHARS", 64)
    monkeypatch.setattr(bpe, "WINDOW", 100)
    for text in (" ".join(words[:5]), " " * 200 + "x" * 100 + "\u3000" + "y z " * 40, ("It's 12 <|endoftext|> o'clock\u2003\u0301 " * 8)):
        assert len(list(bpe._pieces(text))) > 1 and "".join(bpe._pieces(text)) == text
        assert encoder.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_files_of_another_kind():
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "NFKC"}}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.TextEncoder(json.dumps(spec | change))


def test_bpe_special_and_round_trip(spark, odd, empty, library):
    rows = bpe.encode(odd, PATH).collect()
    assert len(rows) == len(odd_rows()) and set(odd.columns) | {"ids", "decoded"} == set(bpe.encode(odd, PATH).columns)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(odd, PATH).drop("decoded"), PATH).select("ids", "decoded").collect()
    assert sorted((r["decoded"], r["ids"]) for r in again) == sorted((r["decoded"], r["ids"]) for r in rows)
    assert bpe.encode(empty, PATH).count() == 0 and bpe.digests(empty, PATH).count() == 0
    nulls = [r for r in bpe.digests(odd, PATH).collect() if r["doc_id"] == 5]
    assert nulls[0]["n_tokens"] == 0 and nulls[0]["ids_sha256"] == nulls[0]["decoded_sha256"] == hexed("")


def test_automaton_follows_ranks():
    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "bc</w>", "ab", "aba", "abc</w>"])}
    merges = [("b", "c</w>"), ("a", "b"), ("ab", "a"), ("a", "bc</w>")]
    found = bpe.TokenizationAutomaton(vocabulary, merges, "</w>")

    def plain(word: str) -> list[str]:
        parts = [*word[:-1], word[-1] + "</w>"]
        for pair in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = ["".join(pair)]
                i += 1
        return parts

    import itertools

    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            word = "".join(letters)
            assert [found.labels[i] for i in found.encode(word.encode())] == plain(word)


def test_automaton_leaves_out_entries_that_no_merge_reaches():
    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", "ab", "bc</w>", "abc</w>"])}
    found = bpe.TokenizationAutomaton(vocabulary, [("b", "c</w>"), ("a", "b"), ("ab", "c</w>")], "</w>")
    assert [found.labels[i] for i in found.encode(b"abc")] == ["a", "bc</w>"]
    with pytest.raises(ValueError):  # a symbol that is no token
        bpe.TokenizationAutomaton({"a": 0, "b": 1, "a</w>": 2}, [], "</w>")
    with pytest.raises(ValueError):  # one token, two merges
        bpe.TokenizationAutomaton(vocabulary, [("b", "c</w>"), ("a", "b"), ("ab", "c</w>"), ("a", "bc</w>")], "</w>")


def test_token_counts_match_the_library(spark, sf_dir, texts):
    vocabulary = tokencount.read_vocabulary(PIECES)
    unknown = next(i for i, (p, _) in enumerate(vocabulary) if p == "<unk>") if any(p == "<unk>" for p, _ in vocabulary) else 0
    unigram = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace()
    rows = queries.op10_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_tokens"] == len(unigram.encode(texts[r["doc_id"]]).ids), r["doc_id"]


def test_token_counts_odd_rows(odd, empty):
    rows = tokencount.count_tokens(odd, PIECES).collect()
    assert len(rows) == len(odd_rows()) and all((r["n_tokens"], r["score"]) == (0, 0.0) for r in rows if r["doc_id"] in (4, 5))
    assert tokencount.count_tokens(empty, PIECES).count() == 0


def test_count_is_that_of_the_best_path():
    model = tokencount.CountViterbi([("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -3.5), ("▁a", -2.5), ("ba", -3.0)])
    assert model.text("ab") == (2, -4.5) and model.text("") == (0, 0.0)
    assert model.text("aba") == (2, -5.5)
    assert model.text("x")[0] == 2


def test_placement_matches_sql(spark, sf_dir):
    sql = queries.ORACLES["op8_placement"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = queries.op8_placement(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(sql).fetchall())


def test_placement_table_is_fair_and_stable(odd, empty):
    table = placement.lookup_table()
    counts = [table.count(i) for i in range(len(placement.SHARDS))]
    assert max(counts) - min(counts) <= 1
    fewer = placement.lookup_table(placement.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(placement.SHARDS) - 1)
    assert moved < 0.1 * len(table)
    placed = placement.place(odd)
    rows = placed.collect()
    assert len(rows) == len(odd_rows()) and set(placed.columns) == {*odd.columns, "slot", "shard"}
    assert {r["slot"] for r in rows if r["doc_id"] is None} == {0} and len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert placement.place(empty).count() == 0
    with pytest.raises(ValueError):
        placement.lookup_table(("a", "a"))
    with pytest.raises(ValueError):
        placement.lookup_table(("a", "b"), 8)
