"""Operator 10: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the pieces that end at each character; dynamic programming
carries the best score and the piece count of each prefix, nothing else. The rules are those
of the tokenizers library's Unigram model behind its Metaspace pre-tokenizer: scores add up in
double precision, of equally good paths the one whose last piece starts first wins, a
character that is no piece itself scores the smallest score less 10 and counts as its UTF-8
bytes where the vocabulary has all byte pieces.

No piece has a space after its first character, so words are independent: a partition keeps
the results of the words it has met in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textscan import WordTable

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 32_000_000  # characters of the table of known words, each counting 200 more


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file; its control symbols are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not model.is_control(i)]


class CountViterbi:
    """Best score and piece count of a text; 0 pieces for an empty one."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = CACHE):
        import ahocorasick

        if any(SPACE in piece.lstrip(SPACE) for piece, _ in vocabulary) or any("\n" in piece for piece, _ in vocabulary):
            raise ValueError("a piece with a space or line end inside makes words depend on each other")
        scores = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.singles = {p for p in scores if len(p) == 1}
        self.words = WordTable(cache)

    def word(self, word: str) -> tuple[int, float]:
        """Count and score of one unit without inner cut points."""
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        if self.singles.issuperset(word):
            for last, (length, score) in self.automaton.iter(word):
                begin = last + 1 - length
                score += best[begin]
                if score > best[last + 1]:
                    best[last + 1] = score
                    count[last + 1] = count[begin] + 1
            return count[n], best[n]
        seen, single = 0, False

        def close(end: int) -> None:
            # the character before end has no piece of its own: the latest start, so it wins only if strictly better
            if not single:
                score = best[end - 1] + self.unknown
                if score > best[end]:
                    best[end] = score
                    count[end] = count[end - 1] + (len(word[end - 1].encode()) if self.bytes else 1)

        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while seen < end:
                if seen:
                    close(seen)
                seen, single = seen + 1, False
            single |= length == 1
            score += best[end - length]
            if score > best[end]:
                best[end] = score
                count[end] = count[end - length] + 1
        while seen <= n:
            if seen:
                close(seen)
            seen, single = seen + 1, False
        return count[n], best[n]

    def line(self, unit: str) -> tuple[int, float]:
        return self.words.young.get(unit) or self.words.put(unit, self.word)

    def unit(self, unit: str) -> tuple[int, float]:
        if "\n" not in unit:
            return self.line(unit)
        parts = [self.line(p) for p in unit.split("\n") if p]
        end_count, end_score = self.line("\n")
        ends = unit.count("\n")
        return sum(p[0] for p in parts) + ends * end_count, sum(p[1] for p in parts) + ends * end_score

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        found = [self.unit(SPACE + w) for w in words]
        return sum(f[0] for f in found), float(sum(f[1] for f in found))


def count_tokens(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens (long) and score (double), the best path's total.

    Null and empty texts have 0 tokens and score 0; very long texts are counted whole. Repeated
    rows give repeated results, an empty table an empty one, and other columns are not read. The vocabulary is read from the driver's path and
    broadcast; its size does not depend on the input.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CountViterbi(shared.value)
        for batch in batches:
            found = [model.text(t) if t else (0, 0.0) for t in batch.column(1).to_pylist()]
            counts, scores = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, scores], [id_col, "n_tokens", "score"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, score double")
