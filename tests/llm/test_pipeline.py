"""The pipeline's stages on what their predecessors kept."""

from __future__ import annotations

from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import odd_rows
from tests.llm.test_dedup import near_brute
from tidemark.llm import quality


def test_stages_in_turn(spark, sf_dir, documents, tmp_path):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in documents.schema]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    first = {r["doc_id"] for r in kept["quality"]}
    scores = quality.quality(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert first == {r["doc_id"] for r in scores if r["predicted"]} and len(first) > 0.4 * len(scores)
    largest: dict[str, int] = defaultdict(int)
    for r in kept["quality"]:
        largest[r["text"] or ""] = max(largest[r["text"] or ""], r["doc_id"])
    assert {r["doc_id"] for r in kept["exact_dedup"]} == set(largest.values())
    groups = near_brute([(r["doc_id"], r["text"]) for r in kept["exact_dedup"]])
    assert {r["doc_id"] for r in kept["near_dedup"]} == {i for i, c in groups.items() if i == c}
    texts = {r["doc_id"]: r["text"] for r in kept["near_dedup"]}
    for r in kept["mixing"]:
        assert all(line in texts[r["doc_id"]] for line in r["text"].split("\n"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed: dict = defaultdict(list)
    for r in kept["mixing"]:
        mixed[r["doc_id"]].append(tuple(library.encode(r["text"], add_special_tokens=False).ids))
    encoded: dict = defaultdict(list)
    for r in kept["encoding"]:
        encoded[r["doc_id"]].append(tuple(r["ids"]))
    assert {i: sorted(v) for i, v in mixed.items()} == {i: sorted(v) for i, v in encoded.items()}


def test_odd_and_empty_tables(spark, odd, empty, sf_dir):
    for docs, most in ((odd, 3 * len(odd_rows())), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= most
            if name != "encoding":
                assert out.columns == docs.columns
