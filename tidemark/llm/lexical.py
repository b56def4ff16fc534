"""Operator 12: ranked lexical search by sort-based accumulation.

Queries come in blocks of a bounded number of terms. For a block, one scan of the documents
writes each one's length and the block's terms it holds; one pass over that table counts the
corpus. Then each range of documents concatenates the (item, document, impact) entries of its
matches, radix sorts the packed keys, sums equal ones with reduceat and keeps every item's best
in a heap; windows in two steps merge the ranges' winners.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import numbered, running_sums, written
from tidemark.llm.textscan import CHUNK_BYTES, chunks, column_bytes, spans, stretches, word_hashes

TOP = 20
BLOCK_TERMS = 200_000  # different terms of items, item by item, that a block holds
ENTRIES = 1 << 21  # (item, document, impact) entries sorted at once
SALTS = 64  # first windows of an item

#: Bytes of a term: ASCII letters and digits and all of UTF-8 beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Vocabulary:
    """Finds the terms of a sorted list in bytes: by hash, then byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        hashes = word_hashes(self.data, self.begins, self.begins + self.lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of a block have one hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and the number of the term."""
        none = np.zeros(0, np.int64)
        if not len(starts) or not len(self.hashes):
            return none, none
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        which = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[which]]
        length = ends[which] - starts[which]
        same = length == self.lengths[term]
        for n in np.unique(length[same]):
            of = np.flatnonzero(same & (length == n))
            reach = np.arange(n)
            found = _LOWER[data[starts[which[of], None] + reach]] == self.data[self.begins[term[of], None] + reach]
            same[of] = found.all(axis=1)
        return which[same], term[same]


def _matches(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows: the first row, terms of each row with repeats, and (row, term, count) of the vocabulary's terms, sorted."""
    data, offsets = column_bytes(column)
    size = max(1, len(vocabulary.lengths))
    for a, b in chunks(offsets, CHUNK_BYTES):
        lengths = np.zeros(b - a, np.int64)
        keys, counts = [], []
        whole = offsets[b] - offsets[a] <= CHUNK_BYTES
        for x, y in [(offsets[a], offsets[b])] if whole else stretches(data, offsets[a], offsets[b], TERM, CHUNK_BYTES):
            part = data[x:y]
            rows = offsets[a : b + 1] - x if whole else np.array([0, y - x])
            starts, ends, firsts = spans(part, rows, TERM)
            lengths += np.diff(firsts)
            which, term = vocabulary.find(part, starts, ends)
            row = np.searchsorted(firsts, which, side="right") - 1
            key, count = np.unique(row * size + term, return_counts=True)
            keys.append(key)
            counts.append(count)
        key, count = keys[0], counts[0]
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        yield a, lengths, key // size, key % size, count


def terms_of(texts: pa.Array) -> list[dict[bytes, int]]:
    """The terms of each row with their numbers of occurrences; for queries, whose terms all count."""
    out: list[dict[bytes, int]] = []
    data, offsets = column_bytes(texts)
    for x, y in zip(offsets[:-1], offsets[1:]):
        found: dict[bytes, int] = {}
        for u, v in stretches(data, x, y, TERM, CHUNK_BYTES):
            part = _LOWER[data[u:v]]
            starts, ends, _ = spans(part, np.array([0, v - u]), TERM)
            raw = part.tobytes()
            for s, e in zip(starts.tolist(), ends.tolist()):
                found[raw[s:e]] = found.get(raw[s:e], 0) + 1
        out.append(found)
    return out


def _queries(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id), and their terms (item, term, times, block); equal rows are one item."""
    items = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    items = numbered(items, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, found in enumerate(terms_of(batch.column("text"))):
                item = pa.array([batch.column("item")[k].as_py()] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([item, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item", "term", "times"])

    terms = written(items.select("item", "text").mapInArrow(run, "item long, term binary, times long"), "query-terms")
    sizes = terms.groupBy("item").agg(F.count("*").alias("terms"))
    blocks = running_sums(sizes, ["item"], {"terms": "before"}).select("item", F.expr(f"before div {BLOCK_TERMS}").alias("block"))
    return items.select("item", "item_id"), written(terms.join(blocks, "item"), "query-blocks")


def _postings(documents: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """id, n, terms and tfs of every row with at least one term; terms are numbers in the vocabulary. Written."""
    id_type = documents.schema[id_col].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        for batch in batches:
            for a, lengths, row, term, count in _matches(batch.column(1), known):
                held = np.flatnonzero(lengths)
                ends = np.searchsorted(row, held, side="right")
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(kind))) for v, kind in ((term, np.int32), (count, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held + a)), pa.array(lengths[held]), *lists], ["id", "n", "terms", "tfs"])

    chosen = documents.select(documents[f"`{id_col}`"].alias("id"), documents[f"`{text_col}`"].cast("string").alias("text"))
    return written(chosen.mapInArrow(run, f"id {id_type}, n long, terms array<int>, tfs array<long>"), "postings")


def radix_sorted(keys: np.ndarray) -> np.ndarray:
    """The order that sorts non-negative keys, equal ones in place: stable passes over digits of 16 bits (numpy sorts these by radix)."""
    order, shift, most = None, 0, int(keys.max(initial=0))
    while order is None or most >> shift:
        digit = ((keys if order is None else keys[order]) >> shift).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
        shift += 16
    return order


class Accumulator:
    """Sums impacts by item and document, range by range, and keeps each item's best in a heap."""

    def __init__(self, items: int, firsts: np.ndarray, item: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, terms: int, top: int):
        self.firsts, self.item, self.times, self.weights = firsts, item, times, weights
        self.documents, self.terms, self.top = documents, terms, top
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a document with less than this cannot enter

    def add(self, ids: list, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        m = 75 + (25 * n * self.documents) // self.terms
        of = np.repeat(np.arange(len(n)), np.diff(offsets))
        impact = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[of]))
        fan = self.firsts[terms + 1] - self.firsts[terms]
        entries = np.concatenate([[0], np.cumsum(fan)])[offsets]
        a = 0
        while a < len(n):  # whole documents, some ENTRIES entries at a time
            b = max(a + 1, int(np.searchsorted(entries, entries[a] + ENTRIES, side="right")) - 1)
            part = slice(offsets[a], offsets[b])
            self._range(ids, a, b, of[part], terms[part], impact[part], fan[part])
            a = b

    def _range(self, ids: list, a: int, b: int, of: np.ndarray, terms: np.ndarray, impact: np.ndarray, fan: np.ndarray) -> None:
        total = int(fan.sum())
        if not total:
            return
        at = np.arange(total) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(self.firsts[terms], fan)
        keys = self.item[at] * (b - a) + np.repeat(of - a, fan)
        values = np.repeat(impact, fan) * self.times[at]
        order = radix_sorted(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        scores = np.add.reduceat(values[order], heads)
        item, doc = keys[heads] // (b - a), keys[heads] % (b - a)
        chosen = np.flatnonzero(scores >= self.least[item])
        for i, d, score in zip(item[chosen].tolist(), doc[chosen].tolist(), scores[chosen].tolist()):
            heap, name = self.heaps[i], ids[a + d]
            entry = (score, name is not None, -(name or 0))  # equal scores: the smaller id, null last
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]


def search(documents: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), the id and score (long) of each item's best documents, those with a score above 0.

    Terms, weights and scores are those of the contract of operator 12 (see the README); equal scores
    rank by ascending id, null last. Null and empty texts hold no term: such documents count nowhere,
    such items find nothing. Repeated documents are documents of their own, equal rows of items one
    item; an empty table on either side gives an empty result; other columns are not read. Long texts
    are cut between terms. An item is a query: the different terms of one have to fit in a task.
    """
    if top < 1:
        raise ValueError("top has to be at least 1")
    spark = documents.sparkSession
    id_type = documents.schema[id_col].dataType.simpleString()
    names, terms = _queries(items, item_col, item_text_col)
    found = [_block(spark, documents, terms.where(F.col("block") == r["block"]), top, id_col, text_col) for r in terms.select("block").distinct().orderBy("block").collect()]
    if not found:
        best = spark.createDataFrame([], f"item long, id {id_type}, score long")
    else:
        best = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(names, "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block(spark, documents: DataFrame, terms: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    """item, id and score of the best documents of each range of documents, for the items of a block."""
    rows = terms.select("item", "term", "times").collect()  # bounded: BLOCK_TERMS and one item's terms
    vocabulary = sorted({bytes(r["term"]) for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    items = sorted({r["item"] for r in rows})
    place = {item: i for i, item in enumerate(items)}
    pairs = sorted((number[bytes(r["term"])], place[r["item"]], r["times"]) for r in rows)
    firsts = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(vocabulary) + 1))
    item, times = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.int64)

    postings = _postings(documents, id_col, text_col, vocabulary)
    counted = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * counted["documents"] + 2) / (2 * r["count"] + 1)))
    shared = spark.sparkContext.broadcast((items, firsts, item, times, weights, counted["documents"], counted["terms"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, *known = shared.value
        best, kind = Accumulator(len(numbers), *known, top), None
        for batch in batches:
            kind = batch.schema.field("id").type
            lists = batch.column("terms"), batch.column("tfs")
            offsets = lists[0].offsets.to_numpy().astype(np.int64)
            values = [v.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64) for v in lists]
            best.add(batch.column("id").to_pylist(), batch.column("n").to_numpy(), offsets - offsets[0], *values)
        if kind is not None:
            rows = [(numbers[i], -negative if named else None, score) for i, heap in enumerate(best.heaps) for score, named, negative in heap]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["item", "id", "score"])

    id_type = documents.schema[id_col].dataType.simpleString()
    return postings.mapInArrow(run, f"item long, id {id_type}, score long")
