"""Operator 5: near duplicates by MinHash bands and odd sketches.

A document's set is its distinct 5-word shingles. Documents with equal sets are one node.
128 MinHash samples per node serve twice: four by four they form 32 band keys, and folded
into a parity bitmap of 512 bits they form an odd sketch. The XOR of two sketches has a
number of ones that estimates the similarity; a candidate pair whose estimate is far below
the threshold goes no further. All others that matter are decided on the full sets.

Each band bucket names one pivot: the member whose buckets are largest in sum, which in a group
of copies is the text they were made from. First every member is decided against its pivots: a
few pairs for each document, however large its buckets. The members of one pivot then form a
group, in which every bucket with that pivot is contained. Groups that still hold several
components are dealt into blocks of bounded size, large components into blocks of their own. The
blocks of a group span a grid; a task gets the members of one cell, two blocks, and compares those
of different components by sketch and then by the full sets, so a member is sent once for each
block of its group that holds another component. Only links leave the tasks. A pair at the
threshold is missed if it shares no band or if its sketches differ by far more than is likely; the
README gives the rate of both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import fresh, numbered, written
from tidemark.llm.textscan import chunks, column_bytes, mix64, word_hashes, word_spans

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_LONGS = SKETCH_BITS // 64
#: Sketches whose estimate is below this are not compared further. In a trial of 400,000 pairs of
#: a true similarity of 0.75 no estimate was (8 were below 0.55).
SKETCH_FLOOR = 0.45
#: A block holds about so many members, or so many bytes of text for each that it could hold.
BLOCK = 1024
MEMBER_BYTES = 8192
MEMBER = ["id", "component", "n", *[f"s{i}" for i in range(SKETCH_LONGS)], "text"]
COLUMNS = 8192  # of a table of shingles and members that are held at a time

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles.

    Fewer words than a shingle has form one shingle together; no words form none.
    """
    data, offsets = column_bytes(column)
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        own = data[part[0] : part[-1]]
        starts, ends, firsts = word_spans(own, part - part[0])
        hashes = word_hashes(own, starts, ends)
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            rolled = mix64(rolled * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + len(rolled)])
        for first, last in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if last - first >= words:
                yield np.unique(rolled[first : last - words + 1])
            elif last > first:
                whole = np.uint64([last - first])
                for k in range(first, last):
                    whole = mix64(whole * np.uint64(0xA0761D6478BD642F) + hashes[k])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """The smallest value of each of the sample functions over a non-empty set."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(folded), block):
        values = (folded[None, a : a + block] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; rows of samples are documents."""
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.astype(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample with its number toggles one bit. As longs, a row per document."""
    n = len(samples)
    bits = mix64(samples.astype(np.uint64) ^ _SALT[None, :]) % np.uint64(SKETCH_BITS)
    flat = (np.arange(n, dtype=np.int64)[:, None] * SKETCH_BITS + bits.astype(np.int64)).ravel()
    parity = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(parity, axis=1).view(np.int64)


def most_ones(similarity: float) -> int:
    """Ones in the XOR of two sketches that are to be expected at a similarity."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "bytes", "set_0", "set_1", "bands", *[f"s{i}" for i in range(SKETCH_LONGS)]]
    for batch in batches:
        sizes, digests, samples = [], [], []
        for shingles in shingle_sets(batch.column(1)):
            sizes.append(len(shingles))
            digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
            samples.append(minhashes(shingles) if len(shingles) else np.zeros(SAMPLES, np.uint32))
        if not sizes:
            continue
        samples, digests = np.array(samples), np.array(digests)
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        sketches = odd_sketches(samples)
        flat = pa.array(band_keys(samples).ravel())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), lengths, pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH_LONGS)]], names)


def signatures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), bytes of text, a 128-bit name of the set, its band keys and its odd sketch, for each row."""
    longs = ", ".join(f"s{i} long" for i in range(SKETCH_LONGS))
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_signatures, f"id long, n long, bytes long, set_0 long, set_1 long, bands array<long>, {longs}")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(4)]
        texts = dict.fromkeys(columns[2]) | dict.fromkeys(columns[3])
        sets = dict(zip(texts, shingle_sets(pa.array(list(texts), pa.string())), strict=True))
        linked = []
        for x, y in zip(columns[2], columns[3], strict=True):
            one, two = sets[x], sets[y]
            common = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * common >= PERCENT * (len(one) + len(two) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two, as a matrix product by columns of shingles."""
    both = np.intersect1d(np.concatenate(one), np.concatenate(two))
    sides = []
    for sets in (one, two):
        rows, places = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        found = np.searchsorted(both, places)
        held = np.flatnonzero(both[np.minimum(found, len(both) - 1)] == places) if len(both) else np.zeros(0, int)
        order = held[np.argsort(found[held], kind="stable")]
        sides.append((rows[order], found[order]))
    out = np.zeros((len(one), len(two)))
    for start in range(0, len(both), COLUMNS):
        tables = []
        for sets, (rows, places) in zip((one, two), sides, strict=True):
            a, b = np.searchsorted(places, [start, start + COLUMNS])
            table = np.zeros((len(sets), min(COLUMNS, len(both) - start)), np.float32)
            table[rows[a:b], places[a:b] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _across(one: pa.StructArray, two: pa.StructArray | None) -> list[tuple[int, int]]:
    """One link for each two components that members of two blocks, or of one block, link."""
    sides = []
    for side in (one, one if two is None else two):
        ids, component, n, *sketch, texts = side.flatten()
        sides.append((ids.to_numpy(), component.to_numpy(), n.to_numpy(), [s.to_numpy() for s in sketch], texts))
    (ids_1, of_1, n_1, s_1, texts_1), (ids_2, of_2, n_2, s_2, texts_2) = sides
    near = of_1[:, None] != of_2
    if two is None:
        near = np.triu(near, 1)
    near &= np.minimum(n_1[:, None], n_2) * 100 >= np.maximum(n_1[:, None], n_2) * PERCENT
    ones = np.zeros(near.shape, np.int16)
    for x, y in zip(s_1, s_2, strict=True):
        ones += np.bitwise_count((x[:, None] ^ y).view(np.uint64))
    near &= ones <= most_ones(SKETCH_FLOOR)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    sets_1, sets_2 = list(shingle_sets(texts_1.take(pa.array(rows)))), list(shingle_sets(texts_2.take(pa.array(columns))))
    common = _common(sets_1, sets_2)
    union = np.array([len(s) for s in sets_1])[:, None] + np.array([len(s) for s in sets_2]) - common
    i, j = np.nonzero((100 * common >= PERCENT * union) & near[np.ix_(rows, columns)])
    i, j = rows[i], columns[j]
    _, first = np.unique(np.sort(np.stack([of_1[i], of_2[j]], axis=1), axis=1), axis=0, return_index=True)
    return list(zip(ids_1[i[first]].tolist(), ids_2[j[first]].tolist(), strict=True))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the members of each cell; those of its second block are marked."""
    for batch in batches:
        for row in range(batch.num_rows):
            second, *fields = batch.column(0).slice(row, 1).flatten().flatten()
            members = pa.StructArray.from_arrays(fields, MEMBER)
            links = _across(members.filter(pc.invert(second)), members.filter(second) if pc.any(second).as_py() else None)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], ["a", "b"])


def _close(one: str, two: str) -> Column:
    """Whether two nodes can be similar: by set sizes and by the ones of their sketches' XOR."""
    sizes = F.least(f"{one}.n", f"{two}.n") * 100 >= F.greatest(f"{one}.n", f"{two}.n") * PERCENT
    return sizes & (_ones(one, two) <= most_ones(SKETCH_FLOOR))


def _ones(one: str, two: str) -> Column:
    return sum((F.bit_count(F.col(f"{one}.s{i}").bitwiseXOR(F.col(f"{two}.s{i}"))) for i in range(SKETCH_LONGS)), F.lit(0))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b")).distinct()


class _Links:
    """Decided links and the components they make so far."""

    def __init__(self, texts: DataFrame):
        self.texts, self.links, self.labels = texts, None, None

    def label(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(column))
        labels = self.labels.select(F.col("id").alias(column), F.col("component").alias("_found"))
        return df.join(labels, column, "left").withColumn(name, F.coalesce("_found", column)).drop("_found")

    def test(self, pairs: DataFrame) -> None:
        """Decide pairs (a, b) on the full sets and add those that link."""
        one = self.texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        two = self.texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        self.add(both.mapInArrow(_compare, "a long, b long"))

    def add(self, links: DataFrame) -> None:
        found = written(links, "linked")
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.labels = components(self.links)


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept, one row per input row.

    Documents are linked where 100 times the intersection of their sets is at least 75 times
    the union; component_id is the smallest id reachable by links. Null and empty texts and
    texts of white space have n_shingles 0 and are their own component. Rows that repeat an id
    are one document, linked through any of their texts. A row with a null id takes part in no group: its
    component_id is null and kept is true. Only the id and text columns are read; an empty
    table gives an empty result.
    """
    sketched = written(signatures(documents, id_col, text_col), "signatures")
    usable = sketched.where("n > 0 and id is not null")
    sets = written(usable.groupBy("set_0", "set_1", "n").agg(F.min("id").alias("rep")), "sets")
    nodes = usable.join(sets.select(F.col("rep").alias("id"), "set_0", "set_1"), ["id", "set_0", "set_1"], "left_semi").dropDuplicates(["id", "set_0", "set_1"])

    keys = nodes.select("id", F.explode("bands").alias("key"))
    shared_keys = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(keys.join(written(shared_keys, "keys"), "key"), "members")
    known = nodes.drop("bands", "set_0", "set_1").join(members.select("id").distinct(), "id", "left_semi")
    known = written(known, "nodes")
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = members.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("top"))
    pivots = pivots.select("key", F.col("top.id").alias("pivot"))
    stars = members.join(pivots, "key").where("id != pivot").select("pivot", "id").distinct()
    stars = written(stars, "stars")

    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = source.join(known.select("id").hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id", "text"])
    links = _Links(written(texts, "texts"))
    one, two = known.alias("one"), known.alias("two")
    pairs = stars.withColumnRenamed("id", "member").join(one, F.col("pivot") == F.col("one.id"))
    links.test(written(_pairs(pairs.join(two, (F.col("member") == F.col("two.id")) & _close("one", "two"))), "pairs"))
    links.add(_cells(links.label(stars, "id", "component"), known, links.texts).mapInArrow(_crossed, "a long, b long"))

    rows = sketched.select("id", "n", "set_0", "set_1").join(sets, ["set_0", "set_1", "n"], "left")
    rows = links.label(rows.withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))), "rep", "component_id")
    return rows.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _cells(stars: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """members of each cell, two blocks or one, of the groups that lie in several components."""
    split = stars.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("pivot")
    placed = stars.join(split, "pivot").join(known.select("id", "bytes"), "id").withColumn("cost", F.greatest(F.lit(1.0), F.col("bytes") / MEMBER_BYTES))
    placed = written(placed.select("pivot", "id", "component", "cost"), "placed")
    costs = placed.groupBy("pivot", "component").agg(F.sum("cost").alias("own"))
    others = costs.groupBy("pivot").agg(F.sum(F.when(F.col("own") < BLOCK, F.col("own"))).alias("mixed"))
    costs = written(costs.join(others, "pivot"), "costs")
    large = F.col("own") >= BLOCK
    part = F.xxhash64("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / BLOCK)))
    shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("mixed") / BLOCK))
    place = F.struct(large.alias("large"), F.when(large, part).otherwise(shared).alias("slot"))
    placed = written(placed.join(costs, ["pivot", "component"]).select("pivot", "id", "component", place.alias("place")), "dealt")
    blocks = written(placed.groupBy("pivot", "place").agg(F.min("component").alias("low"), F.max("component").alias("high")), "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    grid = x.join(y, "pivot").where("x.place <= y.place and least(x.low, y.low) != greatest(x.high, y.high)")
    grid = written(grid.select("pivot", F.col("x.place").alias("one"), F.col("y.place").alias("two")), "grid")
    sides = grid.select("*", F.col("one").alias("place"), F.lit(False).alias("second")).unionByName(grid.where("one < two").select("*", F.col("two").alias("place"), F.lit(True).alias("second")))
    sent = placed.join(sides, ["pivot", "place"]).join(known.drop("bytes"), "id").join(texts, "id")
    return sent.groupBy("pivot", "one", "two").agg(F.collect_list(F.struct("second", *MEMBER)).alias("members")).select("members")


def drop_near(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that stay: of each group of linked rows one with the smallest id.

    Rows are linked by their own sets, so rows that repeat an id and differ in text stay apart;
    of equal rows one stays. Null and empty texts and rows with null ids stay. All columns pass
    through; an empty table gives an empty result.
    """
    (row,) = fresh(documents, "_row")
    rows = numbered(documents, row)
    groups = near_groups(rows.where(F.col(id_col).isNotNull()), row, text_col).select(F.col("id").alias(row), "component_id")
    ids = written(groups.join(rows.select(row, F.col(id_col).cast("long").alias("own")), row), "grouped")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("own", row))[row].alias(row)).select(row)
    stay = rows.join(kept, row, "left_semi").unionByName(rows.where(F.col(id_col).isNull()))
    return stay.select(*[f"`{c}`" for c in documents.columns])
