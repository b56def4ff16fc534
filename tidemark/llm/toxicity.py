"""Operator 6: toxicity by gradient-boosted trees over dense features, calibrated isotonically.

A lexicon is learned first: words, and stems of four and five bytes, that toxic training
documents hold far more often than others. Features of a whole text are then the densities
of lexicon words and stems, how near a second-person word they stand, and the rates of
capitals, punctuation and obfuscated words. Part of the training documents fits the lexicon
and the trees, the rest the calibration.

All models are fitted on at most SAMPLE labelled documents, up to half of them of each label,
chosen by a hash of their ids. For trees and calibration each weighs as many labelled
documents as it stands for, so that scores follow the shares of all labels; the lexicon
compares rates within the labels. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import label_sample, labelled_texts, written
from tidemark.llm.textscan import chunks, column_bytes, mix64, sums_between, word_hashes

SAMPLE = 12_000  # documents that fit lexicon, trees and calibration together
TREES, DEPTH = 16, 3
CALIBRATION_PARTS = 3  # one in so many training documents calibrates
LEXICON_Z, LEXICON_DOCUMENTS, LEXICON_LIFT = 5.0, 4, 6.0
REACH = 5  # words between a lexicon word and a second-person word

# Second-person words of the four languages.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "usted", "ustedes", "ti", "tus", "vosotros"]
# Signs and digits that stand for letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

SLICE = 1 << 16  # words whose keys are held at a time
FEATURES = ["log_words", "lexicon", "lexicon_hits", "stems", "stem_hits", "near_person", "person", "capitals", "capital_words", "punctuation", "exclamation", "obfuscated", "repeated"]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_ALIKE = np.zeros(256, bool)
_FOLD = np.arange(256, dtype=np.uint8)
for _sign, _letter in LOOK_ALIKES.items():
    _ALIKE[ord(_sign)] = True
    _FOLD[ord(_sign)] = ord(_letter)
_WORD = _LETTER | _ALIKE
_WORD[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes: their starts and ends, and each row's first."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Three keys of each word: of itself, of its first five and of its first four bytes; 0 where it is shorter."""
    folded = _FOLD[data]
    out = np.zeros((3, len(starts)), np.uint64)
    for k, length in enumerate((0, 5, 4)):
        stop = ends if not length else np.minimum(ends, starts + length)
        keys = mix64(word_hashes(folded, starts, stop) + np.uint64(k))
        out[k] = np.where(ends - starts > length, keys, 0) if length else keys
    return out


def _scan(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges: bytes, row offsets, word starts, word ends and first words."""
    data, offsets = column_bytes(column)
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        own, part = data[part[0] : part[-1]], part - part[0]
        if len(own):
            yield own, part, *_spans(own, part)
        else:
            none = np.zeros(0, np.int64)
            yield own, part, none, none, np.zeros(len(part), np.int64)


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and key of every distinct lexicon key of each document."""
    for batch in batches:
        labels = batch.column(1).to_pylist()
        row = 0
        for own, part, starts, ends, firsts in _scan(batch.column(0)):
            keys = _keys(own, starts, ends)
            for i in range(len(part) - 1):
                found = np.unique(keys[:, firsts[i] : firsts[i + 1]])
                found = found[found != 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), labels[row], np.int64)), pa.array(found)], ["label", "key"])
                row += 1


def learn_lexicon(labelled: DataFrame) -> np.ndarray:
    """Keys over-represented in toxic documents of labelled (text, label), sorted.

    A key enters if at least LEXICON_DOCUMENTS toxic documents hold it, at LEXICON_LIFT times
    the rate of others, with a two-sample z of LEXICON_Z. labelled is a bounded sample.
    """
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    counts = labelled.select("text", "label").mapInArrow(_distinct_keys, "label long, key long").groupBy("key").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    p1, p0 = F.col("pos") / n1, F.col("neg") / n0
    p = (F.col("pos") + F.col("neg")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(p * (1 - p + 1e-9) * (1 / n1 + 1 / n0))
    kept = counts.where((F.col("pos") >= LEXICON_DOCUMENTS) & (p1 >= LEXICON_LIFT * p0) & (z >= LEXICON_Z))
    return np.sort(np.array([r["key"] for r in kept.select("key").collect()], np.int64).astype(np.uint64))


def _held(keys: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
    return lexicon[at] == keys


def _person_keys() -> np.ndarray:
    words = "".join(SECOND_PERSON).encode()
    ends = np.cumsum([len(w) for w in SECOND_PERSON])
    starts = ends - np.array([len(w) for w in SECOND_PERSON])
    return np.sort(_keys(np.frombuffer(words, np.uint8), starts, ends)[0])


def dense_features(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """The FEATURES of each text of a column; all zero for a text without words."""
    person_keys = _person_keys()
    out = []
    for own, part, starts, ends, firsts in _scan(column):
        rows = len(part) - 1
        n = np.diff(firsts).astype(float)
        size = np.diff(part).astype(float)

        def per_word(flags: np.ndarray, firsts=firsts) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[firsts]).astype(float)

        def per_byte(flags: np.ndarray, part=part) -> np.ndarray:
            found, held = np.zeros(len(part) - 1), part[:-1] < part[1:]
            found[held] = sums_between(flags.view(np.uint8), part[:-1][held], part[1:][held])
            return found

        row_of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(firsts))
        words, stems, person, repeated, near = np.zeros((5, len(starts)), bool)
        for i in range(0, len(starts), SLICE):  # keys of some words at a time, with the word before them
            j, h = min(i + SLICE, len(starts)), max(i - 1, 0)
            keys = _keys(own[starts[h] : ends[j - 1]], starts[h:j] - starts[h], ends[h:j] - starts[h])
            repeated[h + 1 : j] = (keys[0][1:] == keys[0][:-1]) & (row_of[h + 1 : j] == row_of[h : j - 1])
            keys = keys[:, i - h :]
            words[i:j], person[i:j] = _held(keys[0], lexicon), _held(keys[0], person_keys)
            stems[i:j] = words[i:j] | _held(keys[1], lexicon) | _held(keys[2], lexicon)
        before = np.concatenate([[0], np.cumsum(person)])
        for i in range(0, len(starts), SLICE):
            at = np.arange(i, min(i + SLICE, len(starts)))
            low, high = np.maximum(at - REACH, firsts[row_of[at]]), np.minimum(at + REACH + 1, firsts[row_of[at] + 1])
            near[at] = stems[at] & (before[high] > before[low])

        def inside(flags: np.ndarray, starts=starts, ends=ends) -> np.ndarray:
            return sums_between(flags.view(np.uint8), starts, ends)

        letters = inside(_LETTER[own])
        capital_words = (inside(_UPPER[own]) == ends - starts) & (ends - starts > 1)
        obfuscated = (letters > 0) & (inside(_ALIKE[own]) > 0)
        words_n, bytes_n = np.maximum(n, 1), np.maximum(size, 1)
        hits, stem_hits = per_word(words), per_word(stems)
        out.append(
            np.column_stack(
                [np.log1p(n), hits / words_n, hits, stem_hits / words_n, stem_hits, per_word(near) / words_n, per_word(person) / words_n, per_byte(_UPPER[own]) / bytes_n, per_word(capital_words) / words_n, per_byte(_PUNCTUATION[own]) / bytes_n, per_byte(own == 33) / bytes_n, per_word(obfuscated) / words_n, per_word(repeated) / words_n]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def featured(documents: DataFrame, lexicon: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and features, an array of doubles, for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = dense_features(batch.column(0), shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat], [*keep, "features"])

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    text = F.col(text_col).cast("string").alias("_text")
    return documents.select(text, *keep).mapInArrow(run, f"{fields}, features array<double>")


def held_out(doc_id: Column) -> Column:
    """Documents no label is learned from: those whose id's CRC-32 leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of documents.

    Labels are learned only from rows that are not held out, with toxic 0 or 1; an id with
    both labels is left out. Null and empty texts are scored like texts without words. With
    no training row of one of the labels every score is the share of toxic training rows,
    smoothed. Repeated rows are scored each, an empty table gives an empty result, and no other
    column of documents is read. doc_id has to be a number.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("_other"))
    known = known.where("label = _other").where(~held_out(F.col("doc_id")))
    chosen = written(label_sample(known, SAMPLE), "chosen")
    texts = labelled_texts(documents, chosen, text_col)
    sample = written(texts.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATION_PARTS)) == 0), "sample")
    counts = {(r[0], r[1]): r[2] for r in sample.groupBy("calibrates", "label").agg(F.sum("stands_for")).collect()}
    toxic = sum(n for (_, label), n in counts.items() if label)
    scored_rows = documents.select("doc_id", text_col)
    if not all(counts.get((False, label)) for label in (0, 1)):
        prior = (toxic + 1) / (sum(counts.values()) + 2)
        return _result(scored_rows.select("doc_id", F.lit(prior).alias("score")))
    lexicon = learn_lexicon(sample.where("not calibrates"))
    training = written(featured(sample, lexicon, "text", ("label", "stands_for", "calibrates")), "training")
    training = training.select("calibrates", "stands_for", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=2, weightCol="stands_for").fit(training.where("not calibrates"))
    calibration = trees.transform(training.where("calibrates")).select("label", "stands_for", vector_to_array("probability")[1].alias("raw"))
    enough = all(counts.get((True, label)) for label in (0, 1))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="stands_for", predictionCol="score").fit(calibration) if enough else None
    rows = featured(scored_rows, lexicon, text_col).withColumn("features", array_to_vector("features"))
    raw = trees.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("raw"))
    return _result(isotonic.transform(raw) if isotonic else raw.withColumnRenamed("raw", "score"))


def _result(scored: DataFrame) -> DataFrame:
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
