"""Operator 9: exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Sorted blocks get integer names, equal blocks the
same one; then adjacent names are paired and the sorted pairs named, level after level,
until each document has one name. Two texts of as many blocks have the same name exactly
when they are equal: no step compares hashes.

A block's bytes cross the network once. A task sends equal blocks once, as long as it can
hold them: it keeps the last HELD_BLOCKS, and of those before only the ones it has met again.
So a block that every document holds arrives about once for each task that reads texts, one
4-KB block for every file split of, say, 128 MB, and the task that names it does not gather its
occurrences. Pairs are named from their distinct values, and the names go back by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, numbered, written
from tidemark.llm.textscan import column_bytes

BLOCK_BYTES = 4096
HELD_BLOCKS = 16_384  # that a task remembers as sent: at most 64 MB of blocks
NAME_BUCKETS = 1 << 16  # at least; more where there are more values
BUCKET_VALUES = 4096  # that a name bucket is to hold
_LOCAL_BITS = 36

_PIECES = "row long, given long, id long, blocks array<long>, sha string, slot long, block binary"


def _cut(block_bytes: int):
    schema = pa.schema(
        [("row", pa.int64()), ("given", pa.int64()), ("id", pa.int64()), ("blocks", pa.list_(pa.int64())), ("sha", pa.string()), ("slot", pa.int64()), ("block", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _LOCAL_BITS
        row = slot = 0
        held: dict[bytes, int] = {}  # slots of blocks sent in earlier batches
        again: set[bytes] = set()  # those of them met again
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            data = data.tobytes()
            known: dict[bytes, int] = {}
            lists, shas = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                names = []
                for s in range(a, max(b, a + 1), block_bytes):
                    block = data[s : min(s + block_bytes, b)]
                    sent = held.get(block)
                    if sent is None:
                        sent = known.setdefault(block, base + slot + len(known))
                    else:
                        again.add(block)
                    names.append(sent)
                lists.append(names)
                shas.append(hashlib.sha256(data[a:b]).hexdigest())
            n, m = batch.num_rows, len(known)
            rows = pa.array(np.arange(row, row + n) + base)
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(2).cast(pa.int64()), batch.column(0).cast(pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(shas), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema
            )
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.string()), pa.array(known.values(), pa.int64()), pa.array(known.keys(), pa.binary())], schema=schema
                )
            row, slot = row + n, slot + m
            held |= known
            if len(held) > HELD_BLOCKS:
                held = {block: held[block] for block in again} if len(again) <= HELD_BLOCKS // 2 else {}
                again = set()

    return run


def _buckets(values: int) -> int:
    """A power of two of buckets for so many values, so that none holds many more than BUCKET_VALUES; at most 2^30."""
    return min(max(NAME_BUCKETS, 1 << (values // BUCKET_VALUES).bit_length()), 1 << 30)


def _named(values: DataFrame, by: list[str], name: str, buckets: int) -> DataFrame:
    """Integer names in sort order within hash buckets; the same for any number of partitions."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    order = Window.partitionBy("_bucket").orderBy(*by)
    keyed = values.withColumn("_bucket", bucket)
    return keyed.withColumn(name, F.shiftleft(F.col("_bucket"), 32) + F.dense_rank().over(order)).drop("_bucket")


def identities(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """One row per input row: row (its own number), given (that of row_col, if named), id, sha, n_blocks and name.

    Two rows hold equal texts exactly when (n_blocks, name) are equal. Null text counts as
    empty; null ids stay null and repeated rows have rows of their own. Very long texts have
    many blocks; an empty table gives an empty result.
    """
    given = F.col(row_col) if row_col else F.lit(None)
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), given.cast("long").alias("given"))
    pieces = written(source.mapInArrow(_cut(block_bytes), _PIECES), "pieces")
    blocks = pieces.where("slot is not null").select("slot", "block")
    buckets = _buckets(blocks.count())
    names = _named(blocks, ["block"], "name", buckets).select("slot", "name")
    rows = pieces.where("row is not null")
    occurrences = rows.select("row", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "slot"))
    level = written(occurrences.join(names, "slot").select("row", "n_blocks", "pos", "name"), "names")
    done = level.where("n_blocks = 1").select("row", "name")
    # "width" is the number of names a document still has on this level
    level = level.where("n_blocks > 1").select("row", F.col("n_blocks").alias("width"), "pos", "name")
    most = level.agg(F.max("width")).first()[0] or 1
    while most > 1:
        half = F.expr("pos div 2")
        pairs = level.groupBy("row", "width", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        distinct = _named(pairs.select("left", "right").distinct(), ["left", "right"], "name", buckets)
        level = written(
            pairs.join(distinct, ["left", "right"]).select("row", F.expr("cast((width + 1) div 2 as int)").alias("width"), "pos", "name"), "names"
        )
        done = done.unionByName(level.where("width = 1").select("row", "name"))
        level = level.where("width > 1")
        most = (most + 1) // 2
    heads = rows.select("row", "given", "id", "sha", F.size("blocks").alias("n_blocks"))
    return heads.join(done, "row")


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """Groups of equal texts: id, keep_id, group_size, kept, sha and given (row_col, if named), one row per input row.

    The row with the largest id of a group stays; of repeated rows with that id exactly one
    does. Null text equals empty text. A null id is smaller than any other, so keep_id is null
    only where all ids of the group are. An empty table gives an empty result; other columns
    of documents are not read.
    """
    named = written(identities(documents, id_col, text_col, block_bytes, row_col), "identities")
    # written, so that the join can split the rows of a large group over tasks
    groups = written(
        named.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    joined = named.join(groups, ["n_blocks", "name"])
    return joined.select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha", "given")


def drop_exact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that stay, with all their columns.

    The largest id of each group of equal texts stays; where several rows have that id and
    text, one of them stays. Rows with null ids stay only where their group has no other id.
    """
    (row,) = fresh(documents, "_row")
    rows = numbered(documents, row)
    kept = exact_groups(rows, id_col, text_col, row_col=row).where("kept").select(F.col("given").alias(row))
    return rows.join(kept, row, "left_semi").select(*[f"`{c}`" for c in documents.columns])
