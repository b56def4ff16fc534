"""Operator 13 against the library that the rank files belong to."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import odd_rows
from tidemark.llm import bytebpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rank_file(path):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(path), special_tokens={})


@pytest.fixture(scope="module")
def known():
    return library(PATH)


@pytest.fixture(scope="module")
def coder():
    return bytebpe.Coder(bytebpe.read_model(PATH), public_tokenizers.PATTERN)


def wanted(encoding, text):
    ids = encoding.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()


def test_whole_table(spark, sf_dir, texts, known):
    rows = queries.op13_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(tuple(r)[1:] == wanted(known, texts[r["doc_id"]]) for r in rows)


def test_odd_rows_and_empty_tables(spark, odd, empty, known):
    rows = bytebpe.digests(odd, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, *tuple(r)[1:]) for r in rows) == sorted((r[0] or 0, *wanted(known, r[1] or "")) for r in odd_rows())
    assert bytebpe.digests(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode_whole_rows(odd, empty):
    encoded = bytebpe.encode(odd, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == [*odd.columns, "ids"]
    back = bytebpe.decode(encoded, PATH).select("doc_id", "text", "rank", "label").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r[0]), r[1] or "") for r in odd_rows())
    assert bytebpe.decode(bytebpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(st.sampled_from("ab'Sts t0_.\n\r\t  éß日́\x1c\x85\x00﻿"), max_size=40))
def test_any_text(known, coder, text):
    assert coder.encode([text]) == [known.encode_ordinary(text)]
    assert coder.decode(coder.encode([text])[0]) == text.encode()


def test_every_code_point(known, coder):
    texts = [f"a{chr(c)}1{chr(c)}! {chr(c)} b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 100_000):
        assert coder.encode(texts[i : i + 100_000]) == known.encode_ordinary_batch(texts[i : i + 100_000], num_threads=4)


def test_long_texts_in_parts_and_a_full_table(known, coder, monkeypatch):
    monkeypatch.setattr(bytebpe, "MATCHES", 7)
    monkeypatch.setattr(bytebpe, "TABLE_CHARACTERS", 5_000)
    texts = ["", "word", "many words, 12 of them; and so on  \n" * 40, "x" * 9_000 + " y", "", "naïve Ünïcode ☃ 日本語"] * 3
    assert coder.digests(texts) == [wanted(known, t) for t in texts]


def test_tokens_that_merges_do_not_reach(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"cde", b"xyz!"]  # neither cd nor de is a token
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (r * 2) for r, t in enumerate(tokens)))
    model = bytebpe.read_model(str(path))
    assert set(model.unreached) == {b"cde", b"xyz!"}
    own = library(str(path))
    coder = bytebpe.Coder(model, public_tokenizers.PATTERN)
    for text in ("cde", "cde abab", "abcde", " cde", "xyz!", "ab 1"):
        assert coder.encode([text]) == [own.encode_ordinary(text)]


def test_a_file_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "bad.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="byte"):
        bytebpe.read_model(str(path))
