"""Operator 11: conversation structure repair by shortest paths over small integer costs.

A conversation of n rows is a graph of layers: node (i, state) stands before row i, the state
being the last role that was kept (nothing, system, user, assistant). Arcs keep, rerole or
delete a row or insert an empty one; they cost 0 to 6. Dial's bucket queue gives every node's
distance to an accepted end, and a walk along tight arcs, the ASCII-least letter first, gives
the audit. A state and a letter determine the next state, so audits and walks are one to one.

Long conversations are cut into segments of SEGMENT rows, wherever they lie: a segment is a
matrix of distances from state to state, a scan from the end turns these into the distances of
segment ends, segments are walked from all four states at once, and a scan from the start
picks the walks that meet. The scans carry one state or four distances from row to row, one
row for each segment, so a conversation with a third of all rows is solved like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SEGMENT = 4096
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 3, 4, 3, 3
FAR = 1 << 60
#: Which of user and assistant may follow a state.
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: Distance to an accepted end where no rows are left: insertions alone.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: The largest arc is REROLE + OPEN_END; ends of a segment differ by less than a bucket ring.
RING = 16

#: A row's letter: fault * 4 + initial, from 'a' on. Faults: none, blank, duplicate, truncated.
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"

_WHITE = " \t\n\x0b\x0c\r"


def _row_arcs(code: str) -> list[tuple[str, int, int, int]]:
    """Letter, state before, state after and cost of the arcs over a row."""
    fault, initial = divmod(ord(code) - 97, 4)
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if fault in (BLANK, DUPLICATE):
        return arcs
    more = OPEN_END if fault == TRUNCATED else 0
    for q in range(4):
        arcs.append(("R", q, FOLLOWS[q], REROLE + more))
        if initial == 0 and q == NOTHING:
            arcs.append(("K", q, SYSTEM, KEEP + more))
        elif initial in (1, 2) and FOLLOWS[q] == initial + 1:
            arcs.append(("K", q, initial + 1, KEEP + more))
    return arcs


_ARCS = {chr(97 + c): sorted(_row_arcs(chr(97 + c))) for c in range(16)}
_FROM = {c: [[(letter, r, cost) for letter, q, r, cost in arcs if q == state and letter != "D"] for state in range(4)] for c, arcs in _ARCS.items()}
_INTO = {c: [[(q, cost) for _, q, r, cost in arcs if r == into] for into in range(4)] for c, arcs in _ARCS.items()}
_INSERTS_INTO = [[q for q in range(4) if FOLLOWS[q] == into] for into in range(4)]


def distances(codes: str, ends: tuple[int, ...]) -> list[int]:
    """Distance of each node (4 * row + state) to the end; ends: what lies behind the last layer's states.

    Dial's queue: a ring of buckets by distance, nodes settled in its order, from the end back.
    """
    n = len(codes)
    dist = [FAR] * (4 * n) + list(ends)
    ring: list[list[int]] = [[] for _ in range(RING)]
    near = min(ends)
    waiting = 0
    for q, d in enumerate(ends):
        if d < FAR:
            ring[d % RING].append(4 * n + q)
            waiting += 1
    at = near
    while waiting:
        bucket = ring[at % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != at:
                continue  # settled nearer before
            row, state = node >> 2, node & 3
            if row < n:
                for q in _INSERTS_INTO[state]:
                    if at + INSERT < dist[4 * row + q]:
                        dist[4 * row + q] = at + INSERT
                        ring[(at + INSERT) % RING].append(4 * row + q)
                        waiting += 1
            if row:
                for q, cost in _INTO[codes[row - 1]][state]:
                    if at + cost < dist[4 * row - 4 + q]:
                        dist[4 * row - 4 + q] = at + cost
                        ring[(at + cost) % RING].append(4 * row - 4 + q)
                        waiting += 1
        at += 1
    return dist


def walk(codes: str, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """Steps from a state at the first layer along tight arcs, and the state they lead to.

    A step is K or D, U or A (rerole to user or assistant), u or a (insert); last: no rows follow.
    """
    steps = []
    for row, code in enumerate(codes):
        while True:  # D before I before K before R
            here = dist[4 * row + state]
            if here == DELETE + dist[4 * row + 4 + state]:
                steps.append("D")
                break
            follows = FOLLOWS[state]
            if here == INSERT + dist[4 * row + follows]:
                steps.append("ua"[follows - USER])
                state = follows
                continue
            letter, state = next((letter, r) for letter, r, cost in _FROM[code][state] if here == cost + dist[4 * row + 4 + r])
            steps.append("K" if letter == "K" else "UA"[state - USER])
            break
    if last:
        for _ in range(AT_END[state] // INSERT):
            state = FOLLOWS[state]
            steps.append("ua"[state - USER])
    return "".join(steps), state


@lru_cache(maxsize=20_000)
def _short(codes: str) -> tuple[str, int]:
    dist = distances(codes, AT_END)
    return walk(codes, dist, NOTHING, True)[0], dist[NOTHING]


def solve(codes: str) -> tuple[str, int]:
    """Steps and cost of the cheapest repair of a whole conversation."""
    if len(codes) <= 64:
        return _short(codes)
    return _short.__wrapped__(codes)


def audit_of(steps: str) -> str:
    return steps.translate(str.maketrans("UAua", "RRII"))


def illegal_pairs(codes: str) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    initials = "".join("suao"[(ord(c) - 97) % 4] for c in codes)
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


class Repaired(NamedTuple):
    """report: one row for each conversation that has rows; rows: those of the repaired conversations."""

    report: DataFrame
    rows: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that damage leaves, one row for each of conversations.

    crc32 of 'conv_id:turn' modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes out its
    [.!?], 3 repeats it (copies is 2), 4 makes its role user. A null id or turn is one space there and
    stays null; a null role or text is one space.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _identity() -> Column:
    """128 bits of a SHA-256 that tell rows of a conversation by role and text."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def repair(rows: DataFrame) -> Repaired:
    """The cheapest repair of every conversation of rows (conv_id, turn, role, text, copies).

    report has conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs) and audit; rows has
    conv_id, at, seq (both sort), role and text of what stays, rerolls and insertions included.
    A conversation's rows stand by turn, nulls first; rows with equal turns by the SHA-256 of role and
    text, equal ones adjacent, as are the copies of a row. A null conv_id is a conversation of its own.
    Null roles and texts have to be replaced before (damage does so); copies is at least 1. Very long
    texts are reduced to flags and an identity in the JVM and meet the decisions again at the end;
    an empty table gives empty results, further columns are not read.
    """
    last = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))  # 0: none of them, or an empty role
    light = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        _identity().alias("identity"),
        F.when((initial == 0) | (F.col("role") == ""), 3).otherwise(initial - 1).alias("initial"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NO_FAULT).otherwise(TRUNCATED).alias("fault"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    # equal rows of one turn may be many: the row's number splits them among ranges
    light = light.withColumn("number", F.monotonically_increasing_id()).orderBy("conv_id", F.col("turn").asc_nulls_first(), "identity", "number")
    ordered = written(light.select("conv_id", "turn", "identity", "initial", "fault", F.monotonically_increasing_id().alias("at")), "turns")

    firsts = ordered.where(F.col("fault") != BLANK).groupBy("conv_id", "identity").agg(F.min("at").alias("at"))
    marked = ordered.select("conv_id", "at", "initial", "fault").join(firsts.select("at", F.lit(True).alias("first")), "at", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    place = F.expr(f"at div {SEGMENT}").alias("segment")  # ranges of rows begin at multiples of 2^33
    letter = F.chr(97 + 4 * fault + F.col("initial"))
    segments = marked.groupBy("conv_id", place).agg(F.array_sort(F.collect_list(F.struct("at", letter.alias("letter")))).alias("rows"))
    codes = F.array_join(F.transform("rows", lambda r: r["letter"]), "")
    segments = written(segments.select("conv_id", F.col("rows")[0]["at"].alias("at"), codes.alias("codes")), "segments")

    solved = written(_solved(segments), "solved")
    gaps = ordered.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = gaps.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = [F.sum(F.length(F.regexp_replace("codes", f"[^{chr(97 + 4 * f)}-{chr(100 + 4 * f)}]", ""))).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    pieces = F.array_sort(F.collect_list(F.struct("at", F.translate("steps", "UAua", "RRII").alias("audit"))))
    report = solved.groupBy("conv_id").agg(*[c.cast("long") for c in counts], F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    report = report.join(gaps.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    report = report.select("conv_id", "gaps", *[F.col(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")])

    id_type = rows.schema["conv_id"].dataType.simpleString()
    acts = solved.select("conv_id", "at", "steps").mapInArrow(_acts, f"conv_id {id_type}, at long, seq long, step string")
    kept = acts.where(F.col("step").isin("K", "U", "A")).drop("conv_id").join(ordered.select("at", "conv_id", "turn", "identity"), "at")
    texts = rows.select(F.col("conv_id").alias("of"), F.col("turn").cast("long").alias("of_turn"), _identity().alias("of_identity"), "role", "text")
    texts = texts.dropDuplicates(["of", "of_turn", "of_identity"])
    same = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("turn").eqNullSafe(F.col("of_turn")) & (F.col("identity") == F.col("of_identity"))
    role = F.when(F.col("step") == "U", "user").when(F.col("step") == "A", "assistant").otherwise(F.col("role"))
    old = kept.join(texts, same).select("conv_id", "at", "seq", role.alias("role"), "text")
    inserted = F.when(F.col("step") == "u", "user").otherwise("assistant")
    new = acts.where(F.col("step").isin("u", "a")).select("conv_id", "at", "seq", inserted.alias("role"), F.lit("").alias("text"))
    return Repaired(report, old.unionByName(new))


def _solved(segments: DataFrame) -> DataFrame:
    """segments with steps, illegal pairs and cost; a conversation's cost stands at its first segment."""
    id_type = segments.schema["conv_id"].dataType.simpleString()
    pieces = segments.groupBy("conv_id").agg(F.count("*").alias("pieces")).withColumnRenamed("conv_id", "of")
    found = segments.join(pieces, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    out = f"conv_id {id_type}, at long, codes string, steps string, illegal long, cost long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            done = [solve(c) for c in codes]
            illegal = pa.array([illegal_pairs(c) for c in codes], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), batch.column("codes"), pa.array([d[0] for d in done], pa.string()), illegal, pa.array([d[1] for d in done], pa.int64())], ["conv_id", "at", "codes", "steps", "illegal", "cost"])

    short = found.where("pieces = 1").select("conv_id", "at", "codes").mapInArrow(whole, out)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes in batch.column("codes").to_pylist():
                columns = [distances(codes, tuple(0 if q == end else FAR for q in range(4)))[:4] for end in range(4)]
                found.append([columns[end][q] for q in range(4) for end in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "at", "matrix"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ends, began = None, AT_END, False
        for batch in batches:
            found, lasts = [], []
            for c, m in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist()):
                fresh = not began or c != conv
                if fresh:
                    conv, ends, began = c, AT_END, True
                found.append(list(ends))
                lasts.append(fresh)
                ends = tuple(min(m[4 * q + e] + ends[e] for e in range(4)) for q in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(found, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())], ["conv_id", "at", "ends", "last"])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, exits, costs = [], [], []
            for codes, ends, last in zip(*[batch.column(c).to_pylist() for c in ("codes", "ends", "last")]):
                dist = distances(codes, tuple(ends))
                done = [walk(codes, dist, q, last) for q in range(4)]
                steps.append([d[0] for d in done])
                exits.append([d[1] for d in done])
                costs.append(dist[NOTHING])
            arrays = [batch.column("conv_id"), batch.column("at"), batch.column("codes"), pa.array(steps, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64())), pa.array(costs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "at", "codes", "walks", "exits", "cost"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before, began = None, NOTHING, "", False
        for batch in batches:
            states, costs, illegal = [], [], []
            for c, exits, cost, rim in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "exits", "cost", "rim")]):
                fresh = not began or c != conv
                if fresh:
                    conv, state, before, began = c, NOTHING, "", True
                states.append(state)
                costs.append(cost if fresh else 0)
                illegal.append(illegal_pairs(before + rim[0]))
                state, before = exits[state], rim[-1]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(states, pa.int64()), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64())], ["conv_id", "at", "state", "joint", "cost"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([illegal_pairs(c) for c in batch.column("codes").to_pylist()], np.int64)
            joint = batch.column("joint").to_numpy(zero_copy_only=False)
            steps = [w[q] for w, q in zip(batch.column("walks").to_pylist(), batch.column("state").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), batch.column("codes"), pa.array(steps, pa.string()), pa.array(own + joint, pa.int64()), batch.column("cost")], ["conv_id", "at", "codes", "steps", "illegal", "cost"])

    long = found.where("pieces > 1").select("conv_id", "at", "codes")
    scanned = long.mapInArrow(matrices, f"conv_id {id_type}, at long, matrix array<long>").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"))
    scanned = scanned.mapInArrow(suffixes, f"conv_id {id_type}, at long, ends array<long>, last boolean").drop("conv_id")
    walked = long.join(scanned, "at").mapInArrow(walks, f"conv_id {id_type}, at long, codes string, walks array<string>, exits array<long>, cost long")
    walked = written(walked, "walks")
    rim = F.concat(F.substring("codes", 1, 1), F.substring("codes", -1, 1))
    met = walked.select("conv_id", "at", "exits", "cost", rim.alias("rim")).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    met = met.mapInArrow(entries, f"conv_id {id_type}, at long, state long, joint long, cost long").drop("conv_id")
    pieced = walked.drop("cost", "exits").join(met, "at").select("conv_id", "at", "codes", "walks", "state", "joint", "cost").mapInArrow(inner, out)
    return short.unionByName(pieced)


def _acts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each step: the row it is about, or before which it inserts (the last one's number and one for insertions at the end)."""
    for batch in batches:
        steps = batch.column("steps").to_pylist()
        lengths = np.array([len(s) for s in steps], np.int64)
        letters = np.frombuffer("".join(steps).encode(), np.uint8)
        of = np.repeat(np.arange(len(steps)), lengths)
        begins = np.cumsum(lengths) - lengths
        is_row = (letters != ord("u")) & (letters != ord("a"))
        before = np.concatenate([[0], np.cumsum(is_row)])
        ordinal = before[:-1] - before[begins[of]] if len(letters) else before[:-1]
        at = batch.column("at").to_numpy(zero_copy_only=False)[of] + ordinal
        seq = np.arange(len(letters)) - begins[of]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(of)), pa.array(at, pa.int64()), pa.array(seq, pa.int64()), pa.array([chr(c) for c in letters], pa.string())], ["conv_id", "at", "seq", "step"])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired rows (conv_id, at, seq, role, text): SHA-256 of 'role:text' by at and seq, joined by line ends.

    A hash of this kind is a chain, so a conversation's rows pass through one task in order; they
    pass one by one and none is held. Conversations without rows are absent.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        names = ["conv_id", "repaired_sha256"]
        for batch in batches:
            ids, found = [], []
            for c, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]):
                if digest is None or c != conv:
                    if digest is not None:
                        ids.append(conv)
                        found.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(found, pa.string())], names)
            kind = batch.schema.field("conv_id").type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "seq")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """What damage did to every conversation and what the cheapest repair is; one row for each conv_id, null included.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.
    A conversation that damage leaves no rows has zeros, an empty audit and the empty string's hash.
    Repeated rows are rows of their own (the later of equal ones count as duplicates); an empty table
    gives an empty result; other columns are not read.
    """
    rows = damage(conversations)
    report, repaired = repair(rows)
    hashed = digests(repaired).withColumnRenamed("conv_id", "hashed_id")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("id").eqNullSafe(F.col("hashed_id")), "left")
    longs = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("id").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
