"""Operator 3: mix sources to target weights.

The words of each source's documents, in a fixed order, are packed into blocks of fixed
length. For each output shard source counts are drawn: the whole part of each expected count
is given and the rest drawn from a multinomial, first over groups of sources and then within
them, which gives the same counts as one draw over all. What a source draws beyond its limit
is drawn again from the sources that have room. The slots a source has drawn, numbered
through all shards, are mapped to its blocks by pseudorandom permutations of the block
numbers, a new one each time all blocks have been used, and blocks are joined by number.

All draws and permutations depend on the seed alone, so reruns agree. Offsets and targets come
from running sums over sorted ranges, so any number of sources, and any number of documents of
one source or with one id, is spread over tasks. Tables with one row per source are broadcast
up to BROADCAST_SOURCES rows and joined like others beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, numbered, row_hash, running_sums, written
from tidemark.llm.textscan import chunks, column_bytes, mix64, word_counts, word_spans

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
GROUP = 4096  # sources of a group in the draw
BROADCAST_SOURCES = 100_000
SEED = 20240229


def permuted(positions: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, at the given positions.

    Four Feistel rounds on the smallest even number of bits that holds n; values of n or more
    are permuted again.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = positions.astype(np.uint64), np.arange(len(positions))
    limit = n.astype(np.uint64)
    while len(todo):
        left, right, m = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[todo] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) & m)
        out[todo] = left << half[todo] | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(word_counts(batch.column(4)))], ["id", "source", "mark", "tie", "size"])


class Mix:
    """The plan of a mix: sources with their targets, documents placed in blocks, and drawn slots.

    Documents of a source are packed by id, then by a hash of the text, then by that of the whole row
    if row_col, a number of each row, is given. Rows that agree in all of these are interchangeable.
    """

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, row_col: str | None = None):
        self.spark, self.block_words, self.seed, self.limit = documents.sparkSession, block_words, seed, limit
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        tie = row_hash(documents.drop(row_col)) if row_col else F.lit(0)
        columns = [F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("mark"), tie.cast("long").alias("tie"), text.alias("text")]
        if row_col:
            given = documents.select(*columns, F.col(row_col).alias("row"))
            sized = given.select(F.struct("id", "row").alias("id"), "source", "mark", "tie", "text").mapInArrow(_sizes, "id struct<id: long, row: long>, source string, mark long, tie long, size long")
            sized = sized.select("id.id", "source", "mark", "tie", "size", "id.row")
        else:
            sized = documents.select(*columns).mapInArrow(_sizes, "id long, source string, mark long, tie long, size long").withColumn("row", F.monotonically_increasing_id())
        self.documents = written(sized, "sizes")
        self.sources = self._targets(weights)
        self.placed = self._place()
        self.slots = self._draw()

    def _beside(self, table: DataFrame) -> DataFrame:
        """A table with at most one row per source, broadcast where their number allows it."""
        return F.broadcast(table) if self.n_sources <= BROADCAST_SOURCES else table

    def _named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with columns of their source."""
        named = self.sources.select(F.col("source").alias("_source"), *columns)
        return rows.join(self._beside(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def _targets(self, weights: tuple[int, ...]) -> DataFrame:
        totals = self.documents.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"one": F.lit(1).cast("long"), "last": F.col("source").isNull()})
        ranked = running_sums(totals, ["last", "source"], {"one": "rank", "source_size": "start"})
        weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
        ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * self.limit)
        # the level at which weight x level, stopped at the caps, adds up to all sizes: sources stop in
        # the order of cap / weight, and the first that would not stop at the level of the others sets it
        ordered = running_sums(ranked.withColumn("stop", F.col("cap") / F.col("weight")), ["stop", "rank"], {"cap": "given", "weight": "closed", "one": "nth"})
        self.n_sources, total, all_weights = ranked.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        level = (F.lit(total or 0) - F.col("given")) / (F.lit(all_weights or 0.0) - F.col("closed"))
        level = ordered.withColumn("level", level).where("level <= stop").agg(F.min_by("level", "nth")).first()[0] or 0.0
        blocks = F.ceil(F.col("source_size") / self.block_words)
        mixed = ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).withColumn("blocks", blocks)
        expected = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
        return written(mixed.withColumn("expected", F.least(expected, F.col("blocks") * self.limit)).drop("one", "last"), "sources")

    def _place(self) -> DataFrame:
        """Each document with words gets the offset of its first word in its source."""
        keyed = self._named(self.documents.where("size > 0"), "rank", "start").drop("source")
        placed = running_sums(keyed, ["rank", "id", "mark", "tie", "row"], {"size": "before"})
        return placed.select("row", "id", "size", "rank", (F.col("before") - F.col("start")).alias("offset"))

    def _draw(self) -> DataFrame:
        """shard, slot (in its shard), rank and block: what the mix takes, in order."""
        chosen = self.sources.where("expected > 0")
        shards = max(1, round((chosen.agg(F.sum("expected")).first()[0] or 0.0) / SHARD_SLOTS))
        share = F.col("expected") / shards
        whole = F.floor(share).cast("long")
        chosen = written(chosen.select("rank", "blocks", whole.alias("whole"), share.alias("share"), (share - whole).alias("rest"), (F.col("blocks") * self.limit - whole * shards).alias("room")), "shares")
        given = chosen.where("whole > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1).cast("long"))).alias("shard"), "rank", F.col("whole").alias("count"))
        counts = given.unionByName(self._extras(chosen, shards)).groupBy("shard", "rank").agg(F.sum("count").alias("count"))
        counts = written(counts, "counts")
        # a shard has at most about SHARD_SLOTS sources, and a source one row for each shard
        in_shard = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        in_source = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("first", F.coalesce(F.sum("count").over(in_shard), F.lit(0))).withColumn("base", F.coalesce(F.sum("count").over(in_source), F.lit(0)))
        counts = counts.join(self._beside(chosen.select("rank", "blocks")), "rank").select("shard", "rank", "count", "first", "base", "blocks")
        seed, step = self.seed, 1 << 16

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for a in range(0, row["count"], step):
                        i = np.arange(a, min(a + step, row["count"])) + row["base"]
                        turn, position = i // row["blocks"], i % row["blocks"]
                        key = mix64(np.full(len(i), seed * 1_000_003 + row["rank"], np.uint64) + turn.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                        block = permuted(position, np.full(len(i), row["blocks"], np.int64), key)
                        slot = i - row["base"] + row["first"]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["shard"])), pa.array(slot), pa.array(np.full(len(i), row["rank"])), pa.array(block)], ["shard", "slot", "rank", "block"])

        return written(counts.repartition("shard", "rank").mapInArrow(spread, "shard long, slot long, rank long, block long"), "slots")

    def _extras(self, chosen: DataFrame, shards: int) -> DataFrame:
        """shard, rank and count of the slots beyond the whole parts, drawn until no source is beyond its room."""
        n = round(chosen.agg(F.sum("rest")).first()[0] or 0.0)
        need = self.spark.range(shards).select(F.col("id").alias("shard"), F.lit(n).cast("long").alias("n")).where("n > 0")
        kept, round_, weight = None, 0, "rest"
        while True:
            drawn = self._multinomial(need, chosen.select("rank", F.col(weight).alias("weight")), round_)
            drawn = drawn if kept is None else drawn.unionByName(kept).groupBy("shard", "rank").agg(F.sum("count").alias("count"))
            before = F.coalesce(F.sum("count").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            fits = F.least(F.greatest(F.col("room") - before, F.lit(0)), F.col("count"))
            drawn = written(drawn.join(self._beside(chosen.select("rank", "room")), "rank").withColumn("fits", fits), "drawn")
            kept = drawn.where("fits > 0").select("shard", "rank", F.col("fits").alias("count"))
            need = written(drawn.groupBy("shard").agg(F.sum(F.col("count") - F.col("fits")).alias("n")).where("n > 0"), "need")
            full = drawn.groupBy("rank").agg(F.sum("count").alias("n"), F.first("room").alias("most")).where("n >= most").select("rank")
            chosen = chosen.join(self._beside(full), "rank", "left_anti")
            if need.isEmpty() or chosen.isEmpty():
                return kept
            chosen, round_, weight = written(chosen, "open"), round_ + 1, "share"

    def _multinomial(self, need: DataFrame, weights: DataFrame, round_: int) -> DataFrame:
        """shard, rank and count of n draws for each shard of need, in proportion to the weights of ranks."""
        member = F.struct("rank", "weight")
        lists = written(weights.where("weight > 0").groupBy(F.expr(f"rank div {GROUP}").alias("group")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.sum("weight").alias("total")), "groups")
        totals = lists.select("group", "total").orderBy("group").toPandas()  # one row for every GROUP sources
        groups, parts = totals["group"].to_numpy(), totals["total"].to_numpy(float)
        seed = self.seed

        def over_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, n in zip(*[batch.column(c).to_pylist() for c in ("shard", "n")], strict=True):
                    if len(parts):
                        counts = np.random.default_rng([seed, round_, shard]).multinomial(n, parts / parts.sum()).astype(np.int64)
                        some = np.flatnonzero(counts)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(groups[some]), pa.array(counts[some])], ["shard", "group", "n"])

        def over_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ranks, own = np.array([m["rank"] for m in row["members"]], np.int64), np.array([m["weight"] for m in row["members"]])
                    counts = np.random.default_rng([seed, round_, row["shard"], row["group"]]).multinomial(row["n"], own / own.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), row["shard"])), pa.array(ranks), pa.array(counts.astype(np.int64))], ["shard", "rank", "count"])

        # written, so that a task has one Python worker and not one for each draw
        drawn = written(need.select("shard", "n").mapInArrow(over_groups, "shard long, group long, n long"), "group-draws").join(self._beside(lists.select("group", "members")), "group")
        return drawn.select("shard", "group", "n", "members").mapInArrow(over_members, "shard long, rank long, count long").where("count > 0")

    def pieces(self) -> DataFrame:
        """Each document's words by block: row, id, rank, offset, size, block, first and words, with the copies taken."""
        b = self.block_words
        index = F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("size") - 1) / b)))
        cut = self.placed.withColumn("block", index)
        first = F.greatest(F.col("block") * b - F.col("offset"), F.lit(0))
        last = F.least((F.col("block") + 1) * b - F.col("offset"), F.col("size"))
        cut = cut.withColumn("first", first).withColumn("words", last - first)
        copies = self.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("copies"))
        return cut.join(copies, ["rank", "block"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))

    def taken(self) -> DataFrame:
        """id, size, source_size, target and taken, one row per input row."""
        words = self.pieces().groupBy("row", "rank", "id", "size").agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
        known = self.sources.select("rank", "source_size", "target")
        counted = words.join(self._beside(known), "rank").select("id", "size", "source_size", "target", "taken")
        empty = self._named(self.documents.where("size = 0"), "source_size", "target")
        return counted.unionByName(empty.select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mix_report(documents: DataFrame, **options) -> DataFrame:
    """What the mix takes of each document: id, size, source_size, target and taken, in words.

    A null text has size 0; documents without words are taken 0 times. A null source is the
    last one. Repeated rows are documents of their own. Very long texts lie in many blocks. An
    empty table gives an empty result. Other columns are not read.
    """
    return Mix(documents, **options).taken()


def mixed_blocks(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: shard, slot, source and text of each block, its words joined by spaces.

    Null texts and texts without words are in no block; a null source is a source; repeated
    rows are documents of their own; an empty table gives an empty result.
    """
    mix, texts = _with_runs(documents, text_col, options)
    place, size = documents.columns.index(text_col), mix.block_words

    def cut_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks, ats, blocks, out = [], [], [], []
        rank, offset = (batch.column(c).to_pylist() for c in ("rank", "offset"))
        for row, word, first, end, copies in _cuts(batch, place):
            for k in np.flatnonzero(copies).tolist():
                ranks.append(rank[row])
                ats.append(offset[row] + int(first[k]))
                blocks.append(ats[-1] // size)
                out.append(b" ".join([word(w, w + 1) for w in range(first[k], end[k])]))
        columns = [pa.array(c, pa.int64()) for c in (ranks, blocks, ats)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], ["rank", "block", "at", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in chunks(column_bytes(whole.column(0).field(place))[1]):
                yield cut_part(whole.slice(a, b - a))

    parts = texts.mapInArrow(cut, "rank long, block long, at long, words string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: p["words"]), " ")
    blocks = parts.groupBy("rank", "block").agg(whole.alias("text"))  # at most block_words parts in a block
    return mix.slots.join(blocks, ["rank", "block"]).join(mix._beside(mix.sources.select("rank", "source")), "rank").select("shard", "slot", "source", "text")


def _with_runs(documents: DataFrame, text_col: str, options: dict) -> tuple[Mix, DataFrame]:
    """The mix; and row, each row of documents as a struct, with rank, offset and runs, where its part of each block begins and how often that is taken.

    Rows of which nothing is taken are left out.
    """
    (number,) = fresh(documents, "_row")
    rows = numbered(documents, number)
    mix = Mix(rows, text_col=text_col, row_col=number, **options)
    row = F.struct(*[F.col(text_col).cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns])
    runs = mix.pieces().groupBy("row").agg(F.first("rank").alias("rank"), F.first("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("first", "copies"))).alias("runs"), F.max("copies").alias("most"))
    runs = runs.where("most > 0").select(F.col("row").alias(number), "rank", "offset", "runs")
    return mix, rows.select(row.alias("row"), number).join(runs, number).select("row", "rank", "offset", "runs")


def _cuts(batch: pa.RecordBatch, place: int):
    """For each row its number, a function that gives the bytes from one word up to another, and first word, end and copies of its parts of blocks."""
    data, offsets = column_bytes(batch.column(0).field(place))
    starts, ends, firsts = word_spans(data, offsets)
    runs = batch.column("runs")
    lists = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    values = runs.flatten()
    first, copies = (values.field(c).to_numpy() for c in ("first", "copies"))
    for row in range(batch.num_rows):
        base, part = firsts[row], slice(lists[row], lists[row + 1])

        def between(a: int, b: int, base=base) -> bytes:
            return data[starts[base + a] : ends[base + b - 1]].tobytes()

        yield row, between, first[part], np.append(first[part][1:], firsts[row + 1] - base), copies[part]


def mixed_documents(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: the columns of documents, up to three rows for each.

    Row c of a document holds the words of its blocks that were drawn at least c times: its
    own text over each stretch of them, the stretches joined by line ends. n_chars, if there,
    is the new length. Documents of which nothing was drawn are left out, and with them null
    texts and texts without words. Repeated rows are documents of their own; an empty table
    gives an empty result.
    """
    _, texts = _with_runs(documents, text_col, options)
    names = documents.columns
    place, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def cut_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = [], []
        columns = batch.column(0).flatten()
        for row, between, first, end, copies in _cuts(batch, place):
            for copy in range(1, int(copies.max()) + 1):
                taken = np.concatenate([[0], copies >= copy, [0]])
                heads, tails = np.flatnonzero(np.diff(taken) == 1), np.flatnonzero(np.diff(taken) == -1) - 1
                rows.append(row)
                out.append(b"\n".join([between(a, b) for a, b in zip(first[heads].tolist(), end[tails].tolist())]))
        columns = [c.take(pa.array(rows, pa.int64())) for c in columns]
        columns[place] = pa.array(out, pa.binary()).cast(pa.string())
        if chars is not None:
            columns[chars] = pc.utf8_length(columns[place]).cast(columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in chunks(column_bytes(whole.column(0).field(place))[1]):
                yield cut_part(whole.slice(a, b - a))

    return texts.mapInArrow(cut, documents.schema)
