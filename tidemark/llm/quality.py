"""Operator 1: line labels by a linear-chain conditional random field, and document quality.

Every line of a text is labelled good or bad. The field's potentials are linear in the dense
features of a line and of its two neighbours, plus a transition between neighbouring labels.
Training knows document labels only: the lines of good documents are good; those of bad ones
start as bad, and after each fit the lines that the field itself calls good are relabelled,
but for the worst line of each document. A document's quality is the share of its good lines,
by forward-backward marginals weighted with line lengths; a logistic map fitted on training
documents turns it into a probability.

The field is fitted on at most SAMPLE labelled documents, up to half of them of each label,
chosen by a hash of their ids; each weighs as many labelled documents as it stands for, so
that scores follow the shares of all labels. Only line features of the sample reach the
driver, at most CHAIN x CHAINS lines of a text. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import label_sample, labelled_texts, written
from tidemark.llm.textscan import chunks, column_bytes, sums_between, word_hashes, word_spans

SAMPLE = 4_000  # labelled documents that fit the field
ROUNDS, STEPS, RATE, DECAY = 3, 150, 0.1, 1e-3
CHAIN = 64  # lines of a training chain; longer texts give several, each with its outer neighbours' features
CHAINS = 64  # of a training text; of a text with more lines so many chains teach, evenly spread over it

LINE_FEATURES = ["log_bytes", "log_words", "word_length", "upper", "lower", "digits", "stops", "exclamation", "bars", "signs", "repeats", "near_repeats", "capital_start", "wide"]

_UPPER, _LOWER, _DIGIT, _STOP, _SIGN, _WIDE = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_SIGN[[ord(c) for c in "#$%&*@^~+=<>{}[]\\_/"]] = True
_WIDE[128:] = True


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each non-blank line, the line's length in bytes, and each row's first line."""
    starts, ends, firsts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros((0, len(LINE_FEATURES))), np.zeros(0), np.zeros(len(offsets), np.int64)
    line_ends = np.flatnonzero(data == 10)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = np.searchsorted(line_ends, starts[1:]) > np.searchsorted(line_ends, ends[:-1])
    fresh[firsts[:-1][np.diff(firsts) > 0]] = True
    heads = np.flatnonzero(fresh)  # first word of each line
    tails = np.concatenate([heads[1:], [len(starts)]])
    a, b = starts[heads], ends[tails - 1]
    size, words = (b - a).astype(float), (tails - heads).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        return sums_between(table[data].view(np.uint8), a, b) / size

    def only(code: int) -> np.ndarray:
        return sums_between((data == code).view(np.uint8), a, b) / words

    hashes = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))

    def repeats(reach: int) -> np.ndarray:
        again = np.zeros(len(starts), bool)
        for d in range(1, reach + 1):
            again[d:] |= (hashes[d:] == hashes[:-d]) & (row[d:] == row[:-d])
        total = np.concatenate([[0], np.cumsum(again)])
        return (total[tails] - total[heads]) / words

    capital = np.concatenate([[0], np.cumsum(_UPPER[data[starts]])])
    signs = _SIGN | _STOP
    features = np.column_stack(
        [np.log1p(size), np.log1p(words), np.minimum(size / words, 40) / 10, share(_UPPER), share(_LOWER), share(_DIGIT), share(_STOP), only(33), only(124), share(_SIGN & signs) * 10, repeats(1), repeats(8), (capital[tails] - capital[heads]) / words, share(_WIDE)]
    )
    return features, size, np.searchsorted(heads, firsts)


def with_neighbours(features: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its document, and a constant."""
    n, width = features.shape
    out = np.zeros((n, 3 * width + 3))
    out[:, :width] = features
    inner = np.ones(n, bool)
    inner[firsts[:-1][firsts[:-1] < n]] = False  # has a line before it
    out[1:, width : 2 * width] = features[:-1]
    out[~inner, width : 2 * width] = 0
    after = np.zeros(n, bool)
    after[:-1] = inner[1:]
    out[:-1, 2 * width : 3 * width] = features[1:]
    out[~after, 2 * width : 3 * width] = 0
    out[:, 3 * width], out[:, 3 * width + 1], out[:, 3 * width + 2] = inner, after, 1
    return out


def forward_backward(unary: np.ndarray, transition: np.ndarray, firsts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of two labels along each chain, and summed pair marginals.

    unary: line x 2 log potentials; transition: 2 x 2; firsts: the chains' bounds; weight: of
    each line's pair with the line before it, 1 by default. Chains run side by side, the longer
    ones last, one step of all at a time.
    """
    lengths = np.diff(firsts)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    n = len(unary)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    pairs = np.zeros((2, 2))
    if not n:
        return forward, pairs
    begin, length = firsts[:-1][order], lengths[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chains of at least t + 1 lines
    forward[begin] = unary[begin]
    for t in range(1, length[0]):
        at = begin[: alive[t]] + t
        forward[at] = unary[at] + np.logaddexp(forward[at - 1, :1] + transition[0], forward[at - 1, 1:] + transition[1])
        forward[at] -= forward[at].max(axis=1, keepdims=True)
    for t in range(length[0] - 1, 0, -1):
        at = begin[: alive[t]] + t
        ahead = unary[at] + backward[at]
        backward[at - 1] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
        backward[at - 1] -= backward[at - 1].max(axis=1, keepdims=True)
        joint = forward[at - 1][:, :, None] + transition + ahead[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint.sum(axis=0) if weight is None else np.tensordot(weight[at], joint, 1)
    both = forward + backward
    both = np.exp(both - both.max(axis=1, keepdims=True))
    return both / both.sum(axis=1, keepdims=True), pairs


class LineField:
    """Weights of the field, the scale of its features and the map from quality to probability."""

    def __init__(self, mean, scale, weights, transition, slope, shift):
        self.mean, self.scale, self.weights, self.transition, self.slope, self.shift = mean, scale, weights, transition, slope, shift

    def good_lines(self, features: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The marginal probability that each line is good."""
        scaled = np.clip((features - self.mean) / self.scale, -6, 6)
        score = with_neighbours(scaled, firsts) @ self.weights
        unary = np.column_stack([np.zeros(len(score)), score])
        return forward_backward(unary, self.transition, firsts)[0][:, 1]

    def quality(self, good: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Share of good lines by length; 1 for a text without lines."""
        total = np.concatenate([[0], np.cumsum(sizes)])
        value = np.concatenate([[0], np.cumsum(good * sizes)])
        whole = total[firsts[1:]] - total[firsts[:-1]]
        return np.where(whole > 0, (value[firsts[1:]] - value[firsts[:-1]]) / np.maximum(whole, 1), 1.0)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * quality + self.shift)))


def _ascend(gradient, point: np.ndarray, steps: int) -> np.ndarray:
    """Adam on a concave function."""
    m, v = np.zeros_like(point), np.zeros_like(point)
    for k in range(1, steps + 1):
        g = gradient(point)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        point = point + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return point


def fit(features: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, labels: np.ndarray, stands_for: np.ndarray | None = None) -> LineField:
    """Fit the field on documents with labels 1 (good) and 0 (bad), both present.

    stands_for: how many documents each one stands for, 1 by default.
    """
    share = np.ones(len(labels)) if stands_for is None else stands_for / stands_for.mean()
    n = len(features)
    document = np.repeat(np.arange(len(labels)), np.diff(firsts))
    line_share = share[document]
    mean = np.average(features, axis=0, weights=line_share)
    scale = np.sqrt(np.average((features - mean) ** 2, axis=0, weights=line_share)) + 1e-6
    wide = with_neighbours(np.clip((features - mean) / scale, -6, 6), firsts)
    bad = labels[document] == 0
    # both labels weigh as much, whatever their shares
    weight = np.where(bad, 0.5 / max(1, bad.sum()), 0.5 / max(1, (~bad).sum())) * n
    target = (~bad).astype(float)
    within = np.arange(n) - firsts[:-1][document]
    chains = np.concatenate([np.flatnonzero(within % CHAIN == 0), [n]])
    at = np.flatnonzero(within % CHAIN)
    point = np.zeros(wide.shape[1] + 4)

    for round_ in range(ROUNDS):
        hard = target.astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (hard[at - 1], hard[at]), line_share[at])

        def gradient(point: np.ndarray, seen=seen) -> np.ndarray:
            score = wide @ point[:-4]
            marginal, pairs = forward_backward(np.column_stack([np.zeros(n), score]), point[-4:].reshape(2, 2), chains, line_share)
            w = wide.T @ ((target - marginal[:, 1]) * weight) / n
            return np.concatenate([w, ((seen - pairs) / line_share.sum()).ravel()]) - DECAY * point

        point = _ascend(gradient, point, STEPS if round_ == 0 else STEPS // 3)
        field = LineField(mean, scale, point[:-4], point[-4:].reshape(2, 2), 1.0, 0.0)
        good = field.good_lines(features, firsts)
        worst = np.full(len(labels), np.inf)
        np.minimum.at(worst, document, good)
        target = np.where(bad, (good > 0.5) & (good > worst[document]), True).astype(float)
    quality = field.quality(good, sizes, firsts)

    def platt(ab: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(ab[0] * quality + ab[1])))
        off = share * (labels - p)
        return np.array([(off * quality).mean(), off.mean()]) - 1e-5 * ab

    field.slope, field.shift = _ascend(platt, np.array([8.0, -6.0]), 1500)
    return field


def _spread(lines: np.ndarray) -> np.ndarray:
    """The lines, or CHAINS chains evenly spread over them where there are more."""
    if len(lines) <= CHAIN * CHAINS:
        return lines
    begins = np.linspace(0, len(lines) - CHAIN, CHAINS).astype(int)
    return np.concatenate([lines[a : a + CHAIN] for a in begins])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, stands_for and the bytes of each document's line features, with line sizes as last column."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        out = []
        for a, b in chunks(offsets):
            part = offsets[a : b + 1]
            features, sizes, firsts = line_features(data[part[0] : part[-1]], part - part[0])
            rows = np.column_stack([features, sizes]).astype(np.float32)
            out += [_spread(rows[x:y]).tobytes() for x, y in zip(firsts[:-1], firsts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], ["doc_id", "label", "stands_for", "lines"])


def held_out(doc_id: Column) -> Column:
    """Documents no label is learned from: those whose id's CRC-32 leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> LineField | float:
    """The field learned from labels (doc_id, quality); the smoothed share of good rows where a label is missing."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_other"))
    known = known.where("label = _other").where(~held_out(F.col("doc_id")))
    chosen = written(label_sample(known, SAMPLE), "chosen")
    sample = labelled_texts(documents, chosen, text_col).select("text", "doc_id", "label", "stands_for").mapInArrow(_lines, "doc_id long, label long, stands_for double, lines binary").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["lines"]))
    labels_found = np.array([r["label"] for r in sample], float)
    stands_for = np.array([r["stands_for"] for r in sample], float)
    prior = float((labels_found @ stands_for + 1) / (stands_for.sum() + 2))
    if not len(labels_found) or labels_found.min() == labels_found.max():
        return prior
    lines = [np.frombuffer(r["lines"], np.float32).reshape(-1, len(LINE_FEATURES) + 1) for r in sample]
    firsts = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    table = np.concatenate(lines).astype(float)
    if not len(table):
        return prior
    return fit(table[:, :-1], table[:, -1], firsts, labels_found, stands_for)


def scored(documents: DataFrame, model: LineField | float, text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    if isinstance(model, float):
        return documents.select("doc_id", F.lit(model).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                features, sizes, firsts = line_features(data[part[0] : part[-1]], part - part[0])
                out.append(field.score(field.quality(field.good_lines(features, firsts), sizes, firsts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"doc_id {id_type}, score double")


def line_labels(documents: DataFrame, model: LineField, text_col: str = "text") -> DataFrame:
    """doc_id, line (counted from 0 among non-blank lines), n_bytes and good, the marginal, for every line.

    Null texts and texts of white space have no lines; repeated rows give their lines each; null ids stay null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                features, sizes, firsts = line_features(data[part[0] : part[-1]], part - part[0])
                row = np.repeat(np.arange(b - a), np.diff(firsts))
                ids = batch.column(0).slice(a, b - a).take(pa.array(row))
                number = np.arange(len(features)) - firsts[:-1][row]
                good = shared.value.good_lines(features, firsts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(sizes.astype(np.int64)), pa.array(good)], ["doc_id", "line", "n_bytes", "good"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"doc_id {id_type}, line long, n_bytes long, good double")


def quality(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of documents.

    Labels are learned only from rows that are not held out, with quality 0 or 1; an id with
    both labels is left out. Null and empty texts and texts of white space have no lines and
    the score of a text whose lines are all good; very long texts are scored whole. With no
    training row of one of the labels every score is the smoothed share of good ones. Repeated
    rows are scored each, an empty table gives an empty result, and other columns are not read.
    doc_id has to be a number.
    """
    score = scored(documents, train(documents, labels, text_col), text_col)
    return score.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of documents with a score of at least 0.5, with all their columns."""
    model = train(documents, labels, text_col)
    if isinstance(model, float):
        return documents.where(F.lit(model >= 0.5))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(place))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                part = offsets[a : b + 1]
                features, sizes, firsts = line_features(data[part[0] : part[-1]], part - part[0])
                out.append(field.score(field.quality(field.good_lines(features, firsts), sizes, firsts)))
            yield batch.filter(pa.array(np.concatenate(out) >= 0.5))

    return documents.mapInArrow(run, documents.schema)
