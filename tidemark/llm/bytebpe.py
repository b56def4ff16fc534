"""Operator 13: byte-level BPE through a sentencepiece model written straight from the ranks.

The file of ranks (token bytes in base64, rank) becomes a sentencepiece BPE model, serialised
here field by field: every byte is mapped to one character, a piece's score is its negative
rank, and the normaliser is the identity. Merging the adjacent pair of highest score, the
leftmost of equals, is then merging by lowest rank. A pre-token that is itself a token but that
merges do not reach gets its own rank, as the rank files' own library has it; such tokens are
found when the model is built. Texts are split by the pattern, pre-tokens are encoded one by
one, and decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.shared import fresh

MATCHES = 1 << 19  # pre-tokens that are held at once
TABLE_CHARACTERS = 150_000_000  # of the table of known pre-tokens
WORD_COST = 300  # characters that each one counts for more
LONG_WORD = 4096  # longer ones are not kept

#: Field numbers and values of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCABULARY_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

#: Character of byte b is chr(FIRST + b): letters without a meaning to any normaliser.
FIRST = 0x100


class Model(NamedTuple):
    """What tasks need: the serialised model, the tokens by piece, their ranks, and whole tokens that merges miss."""

    proto: bytes
    tokens: list[bytes]
    ranks: list[int]
    unreached: dict[bytes, int]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def mapped(data: bytes) -> str:
    """One character for each byte."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + FIRST).tobytes().decode("utf-16-le")


def serialised(tokens: list[bytes], ranks: list[int]) -> bytes:
    """A sentencepiece BPE model whose pieces are tokens, in their order, and an unknown one at the end."""
    if len(ranks) and max(ranks) >= 1 << 24:
        raise ValueError("scores are single floats, which hold ranks below 2^24")
    out = []
    for token, rank in zip(tokens, ranks):
        score = _varint(SCORE << 3 | 5) + struct.pack("<f", -rank)
        out.append(_block(PIECES, _block(PIECE, mapped(token).encode()) + score))
    out.append(_block(PIECES, _block(PIECE, b"<unk>") + _number(TYPE, UNKNOWN)))
    trainer = [(MODEL_TYPE, BPE), (VOCABULARY_SIZE, len(tokens) + 1), (UNK_ID, len(tokens)), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)]
    out.append(_block(TRAINER, b"".join(_number(f, n) for f, n in trainer)))
    plain = b"".join(_number(f, 0) for f in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))
    out.append(_block(NORMALIZER, _block(NAME, b"identity") + plain))
    return b"".join(out)


def read_model(path: str) -> Model:
    """The model of a file of ranks; every single byte has to be a token."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in found for b in range(256)):
        raise ValueError("a byte is no token of its own")
    tokens = sorted(found, key=found.__getitem__)
    ranks = [found[t] for t in tokens]
    model = Model(serialised(tokens, ranks), tokens, ranks, {})
    pieces = Coder(model, "").pieces([mapped(t) for t in tokens])
    return model._replace(unreached={t: found[t] for i, t in enumerate(tokens) if pieces[i] != [i]})


class Coder:
    """Encodes and decodes texts; holds the model and a bounded table of pre-tokens.

    Pre-tokens are numbered part by part, so the table is asked once for each distinct one. It
    has a young and an old half; when the young one is full the old one goes.
    """

    def __init__(self, model: Model, pattern: str):
        import regex
        import sentencepiece

        self.model = model
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        self.pattern = regex.compile(pattern)
        self.by_rank = dict(zip(model.ranks, model.tokens))
        self.young: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}
        self.held = 0

    def pieces(self, words: list[str]) -> list[list[int]]:
        return self.processor.encode(words, out_type=int, num_threads=1)

    def ids(self, words: list[str]) -> list[list[int]]:
        """Ranks of each pre-token; none is empty."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        cut = mapped(b"\xff".join(raw)).split(chr(FIRST + 255))  # no UTF-8 holds this byte
        ranks, unreached = self.model.ranks, self.model.unreached
        found = [[ranks[p] for p in pieces] for pieces in self.pieces(cut)]
        return [[unreached[w]] if w in unreached else f for w, f in zip(raw, found)] if unreached else found

    def decode(self, ids: list[int]) -> bytes:
        by_rank = self.by_rank
        return b"".join([by_rank[i] for i in ids])

    def entries(self, words: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Of distinct pre-tokens: number of ids, each id's decimals behind a space, and the bytes that the ids decode to."""
        if self.held > TABLE_CHARACTERS // 2:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        found = list(map(young.get, words))
        new = []
        for i in [i for i, entry in enumerate(found) if entry is None]:
            found[i] = old.get(words[i])
            if found[i] is None:
                new.append(i)
            else:
                self._put(words[i], found[i])
        for i, ids in zip(new, self.ids([words[i] for i in new])):
            found[i] = len(ids), "".join([f" {n}" for n in ids]).encode(), self.decode(ids)
            self._put(words[i], found[i])
        return found

    def _put(self, word: str, entry: tuple[int, bytes, bytes]) -> None:
        if len(word) <= LONG_WORD:
            self.young[word] = entry
            self.held += len(word) + WORD_COST

    def parts(self, texts: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Pre-tokens of several texts, the number of each text in texts and where its pre-tokens end; a long text takes several parts."""
        words, of, ends = [], [], []
        for k, text in enumerate(texts):
            if len(text) <= MATCHES:
                words += self.pattern.findall(text)
                of.append(k)
                ends.append(len(words))
            else:
                matches = (m.group() for m in self.pattern.finditer(text))
                while some := list(islice(matches, MATCHES)):
                    words += some
                    yield words, [*of, k], [*ends, len(words)]
                    words, of, ends = [], [], []
            if len(words) >= MATCHES:
                yield words, of, ends
                words, of, ends = [], [], []
        yield words, of, ends

    def coded(self, texts: list[str]) -> Iterator[tuple[int, int, memoryview, memoryview]]:
        """Number of the text, number of ids, their decimals and what they decode to, text by text or part by part."""
        for words, of, ends in self.parts(texts):
            numbers = dict.fromkeys(words)
            numbers = dict(zip(numbers, range(len(numbers))))
            which = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            entries = self.entries(list(numbers))
            counts = np.concatenate([[0], np.cumsum(np.array([e[0] for e in entries], np.int64)[which])])
            views = []
            for k in (1, 2):
                joined = pa.array([e[k] for e in entries], pa.large_binary()).take(pa.array(which))
                views.append((memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64)))
            (ids, id_ends), (decoded, decoded_ends) = views
            begin = 0
            for k, end in zip(of, ends):
                yield k, int(counts[end] - counts[begin]), ids[id_ends[begin] : id_ends[end]], decoded[decoded_ends[begin] : decoded_ends[end]]
                begin = end

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for k, _, ids, _ in self.coded(texts):
            out[k] += map(int, bytes(ids).split())
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, SHA-256 of their decimals joined by spaces, and of the bytes they decode to."""
        totals, hashes = [0] * len(texts), [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        for k, count, ids, decoded in self.coded(texts):
            hashes[k][0].update(ids if totals[k] else ids[1:])
            hashes[k][1].update(decoded)
            totals[k] += count
        return [(n, i.hexdigest(), d.hexdigest()) for n, (i, d) in zip(totals, hashes)]


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(tuple(read_model(path)))


def encode(documents: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """documents with ids (array of int), the token ids of each row's text.

    Null and empty texts have none; repeated rows repeat; a very long text is split and encoded
    some 500,000 pre-tokens at a time; an empty table stays empty. A column ids of the input is
    replaced, all others stay. The file of ranks is read on the driver and broadcast.
    """
    shared = _shared(documents, path)
    kept = documents.drop("ids")
    [text] = fresh(kept, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Model(*shared.value), pattern)
        for batch in batches:
            ids = pa.array(coder.encode([t or "" for t in batch.column(text).to_pylist()]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([c for n, c in zip(batch.schema.names, batch.columns) if n != text] + [ids], [n for n in batch.schema.names if n != text] + ["ids"])

    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return kept.withColumn(text, kept[f"`{text_col}`"].cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with text, what ids decode to; bytes that are no UTF-8 become U+FFFD. Null ids give ''.

    A column text of the input is replaced, all others stay; an empty table stays empty. An id
    that the file lacks is an error.
    """
    shared = _shared(encoded, path)
    kept = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Model(*shared.value), "")
        for batch in batches:
            texts = pa.array([coder.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("text", StringType())]))


def digests(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens (long), and SHA-256 of the ids' decimals and of the bytes they decode to.

    Nulls count as empty: no tokens and the hash of nothing; repeated rows and ids repeat; an empty
    table gives an empty result; other columns are not read. Of a long text no more than some
    500,000 pre-tokens are held at once; a pre-token itself is whole in memory.
    """
    shared = _shared(documents, path)
    id_type = documents.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Model(*shared.value), pattern)
        for batch in batches:
            found = coder.digests([t or "" for t in batch.column(1).to_pylist()])
            arrays = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    chosen = documents.select(id_col, documents[f"`{text_col}`"].cast("string"))
    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
