"""Operator 2: BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts as one state that loops on every symbol. Each merge
(u, v), in order of rank, applies a gadget: where u leads to a state from which v leads on,
an arc labelled uv spans both, and u now leads to a copy of that state without the arc v.
What remains are the paths that byte-pair encoding itself produces, one for each word.

Since all arcs with one label lead to one state, and a state differs from the one it was copied
from by one arc, the automaton is held in integer tables: the parts of each token, the number
of the gadget that made it, and the gadgets in the order of the arcs they took away. Arcs that
were asked for stay in a table of fixed size. Symbols are bytes and an end
mark; a second table, the trie of all tokens, lists the tokens that begin at each symbol.

Texts are encoded many at a time, all distinct words of a part together: at each place of a
word exactly one token ends such that the automaton can take it, and following these tokens
back from the end of the word gives its arc labels. Decoding emits the labels of ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.textscan import chunks, column_bytes

PART_CHARS = 1 << 20  # of text that are encoded at a time
END = 256  # the symbol that closes a word
SYMBOLS = 257
NEVER = np.int32(2**31 - 1)  # comes after every merge
ARC_SLOTS = 1 << 20  # remembered arcs, eight bytes each
WINDOW = 1 << 18  # tokens of long words whose arcs are looked up together
LOCKSTEP = 128  # places of a word up to which all words go on together; the rest of a longer word goes alone

# The byte alphabet of byte-level vocabularies. Printable bytes stand for
# themselves, the others for the code points from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SYMBOLS = {b: chr(b) for b in _PRINTABLE}
BYTE_SYMBOLS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in BYTE_SYMBOLS)}

# Code points with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_SIGN = re.compile("[" + "".join(map(chr, WHITE)) + "]")

# What a tokenizer file has to ask for, and the endings that are words of their own.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTING = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

SPACE, LETTER, NUMBER, SIGN, SPECIAL = range(5)

# Ranges of letters and numbers that the tokenizers library knows and this Python's Unicode database may not.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Capital letters that the library lowers and this Python may not, and the distances to the small ones.
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
# Ranges of marks that the library's normaliser does not know, so that it neither moves nor joins them.
UNKNOWN_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
_MARKS = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN_MARKS) + "])")
_LOWERED = {c: c + by for a, b, by in NEWER_CAPITALS for c in range(a, b + 1)} | {ord("Σ"): "σ"}  # capital sigma as it stands, not by its place in the word
HOLD = 0xD800  # surrogates, which no text holds, stand for special tokens


class TokenizationAutomaton:
    """Deterministic automaton over tokens, compiled from ranked merges.

    The vocabulary must hold every symbol it uses alone, with and without the end mark, and no
    token may be made by two merges; ValueError otherwise.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], mark: str):
        byte_of = {s: b for b, s in BYTE_SYMBOLS.items()}
        self.labels = {i: t for t, i in vocabulary.items()}
        self.size = max(vocabulary.values()) + 1
        pieces = {i: [byte_of[c] for c in t.removesuffix(mark)] + [END] * t.endswith(mark) for t, i in vocabulary.items()}
        alone = {p[0] for p in pieces.values() if len(p) == 1}
        closed = {p[0] for p in pieces.values() if len(p) == 2 and p[1] == END}
        used = {s for p in pieces.values() for s in p} - {END}
        if not used <= alone or not used <= closed:
            raise ValueError("a symbol of the vocabulary is no token of its own")
        # Merge k, from 1 on, is a gadget: it left of arc v out of the state that u leads to only those before it.
        self.left, self.right, self.made = (np.zeros(self.size, np.int32) for _ in range(3))
        pairs, numbers = np.zeros(len(merges), np.int64), np.arange(1, len(merges) + 1, dtype=np.int32)
        for k, (a, b) in enumerate(merges, 1):
            u, v, uv = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.made[uv] or uv in (u, v):
                raise ValueError(f"two merges make {a + b!r}")
            self.left[uv], self.right[uv], self.made[uv] = u, v, k
            pairs[k - 1] = u * self.size + v
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.numbers = pairs[order], numbers[order]
        if len(merges) and (np.maximum(self.made[self.pairs // self.size], self.made[self.pairs % self.size]) >= self.numbers).any():
            raise ValueError("a merge comes before one that makes its parts")
        # a merge that finds no arc to span, or a part that no path holds, leaves its token on no path
        applies = self._keeps((pairs // self.size).astype(np.int32), (pairs % self.size).astype(np.int32), numbers)
        for (a, b), works in zip(merges, applies.tolist(), strict=True):
            if not (works and vocabulary[a] in pieces and vocabulary[b] in pieces):
                del pieces[vocabulary[a + b]]
        self._build_trie({i: p for i, p in pieces.items() if self.made[i] or len(p) == 1 or len(p) == 2 and p[1] == END})
        self.arcs = np.full(ARC_SLOTS, -1, np.int64)

    def _build_trie(self, pieces: dict[int, list[int]]) -> None:
        """Sorted keys of node and symbol, and the node that each leads to; token[node] ends there, -1 for none."""
        edges: dict[int, int] = {}
        ends = {}
        for i, piece in pieces.items():
            node = 0
            for symbol in piece:
                node = edges.setdefault(node * SYMBOLS + symbol, len(edges) + 1)
            ends[node] = i
        keys, nodes = np.fromiter(edges, np.int32, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]
        self.token = np.full(len(edges) + 1, -1, np.int32)
        self.token[list(ends)] = list(ends.values())

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next node of the trie, 0 for none."""
        key = node * np.int32(SYMBOLS) + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], 0)

    def _gadget(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The number of the merge of u and v, NEVER where there is none."""
        key = u.astype(np.int64) * self.size + v
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.numbers[at], NEVER) if len(self.pairs) else np.full(len(key), NEVER)

    def _keeps(self, before: np.ndarray, tokens: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the state that a token leads to has an arc for the next; until: after the gadgets before these numbers, all by default.

        A state is a copy of the one its token's right part led to when the token was made, and
        lost an arc by each later gadget of the token; so back to the start. An arc younger than
        a gadget went wherever its left part went.
        """
        found = np.ones(len(before), bool)
        at, u = np.arange(len(before)), before
        until = np.full(len(before), NEVER) if until is None else until
        while len(at):
            lost = np.zeros(len(at), bool)
            row, v, younger = np.arange(len(at)), tokens[at], np.full(len(at), NEVER)
            while len(row):
                gadget = self._gadget(u[row], v)
                hit = (gadget < until[row]) & (gadget <= younger)
                lost[row[hit]] = True
                on = ~hit & (self.made[v] > 0)
                row, v, younger = row[on], self.left[v[on]], self.made[v[on]]
            found[at[lost]] = False
            on = ~lost & (self.made[u] > 0)
            at, u, until = at[on], self.right[u[on]], self.made[u[on]]
        return found

    def has_arcs(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token leads on from the state that the token before it leads to."""
        pair = before.astype(np.int64) * self.size + tokens
        slot = (pair * 0x9E3779B1 >> 11) & (ARC_SLOTS - 1)
        held = self.arcs[slot]
        found = (held & 1).astype(bool)
        missing = np.flatnonzero(held >> 1 != pair)
        if len(missing):
            new, back = np.unique(pair[missing], return_inverse=True)
            known = self._keeps((new // self.size).astype(np.int32), (new % self.size).astype(np.int32))
            self.arcs[(new * 0x9E3779B1 >> 11) & (ARC_SLOTS - 1)] = new << 1 | known
            found[missing] = known[back]
        return found

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as bytes and n + 1 offsets; and the n + 1 offsets of the words' tokens. No word is empty."""
        n = len(offsets) - 1
        ends = offsets[1:] + np.arange(1, n + 1)
        starts = ends - np.diff(offsets) - 1
        symbols = np.full(len(data) + n, END, np.int32)
        plain = np.ones(len(symbols), bool)
        plain[ends - 1] = False
        symbols[plain] = data
        first = np.repeat(starts, ends - starts)

        begin, length = np.flatnonzero(plain), 1
        node = self._step(np.zeros(len(begin), np.int32), symbols[begin])
        begins, stops, tokens = [], [], []
        while len(begin):
            token = self.token[node]
            hit = np.flatnonzero(token >= 0)
            begins.append(begin[hit])
            stops.append(begin[hit] + length)
            tokens.append(token[hit])
            on = np.flatnonzero(symbols[begin + length - 1] != END)  # a word ends there
            begin = begin[on]
            node = self._step(node[on], symbols[begin + length])
            on = np.flatnonzero(node)
            begin, node = begin[on], node[on]
            length += 1
        begin, stop, token = np.concatenate(begins), np.concatenate(stops), np.concatenate(tokens)
        place = np.minimum(stop - first[begin], LOCKSTEP + 1)
        order = np.argsort(place.astype(np.uint16), kind="stable")
        begin, stop, token, place = begin[order], stop[order], token[order], place[order]
        at_start = begin == first[begin]

        # up to each place, the token that ends there and its length
        last, size = np.zeros(len(symbols) + 1, np.int32), np.zeros(len(symbols) + 1, np.int32)
        cuts = np.searchsorted(place, np.arange(1, LOCKSTEP + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                break
            on = at_start[a:b] | self.has_arcs(last[begin[a:b]], token[a:b])
            to = stop[a:b][on]
            last[to] = token[a:b][on]
            size[to] = to - begin[a:b][on]
        self._go_on(begin[cuts[-1] :], stop[cuts[-1] :], token[cuts[-1] :], last, size)
        return self._labels(starts, ends, last, size)

    def _go_on(self, begin, stop, token, last, size) -> None:
        """The places of long words beyond LOCKSTEP, one after the other; the arcs that can matter are looked up ahead, WINDOW tokens at a time."""
        order = np.argsort(stop, kind="stable")
        begin, stop, token = begin[order], stop[order], token[order]
        for a in range(0, len(begin), WINDOW):
            b, e, t = begin[a : a + WINDOW], stop[a : a + WINDOW], token[a : a + WINDOW]
            low, high = np.searchsorted(stop, b), np.searchsorted(stop, b, side="right")
            counts = high - low
            before = token[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            settled = size[b] > 0
            pairs = np.unique(np.concatenate([before * np.int64(self.size) + np.repeat(t, counts), last[b[settled]] * np.int64(self.size) + t[settled]]))
            found = self.has_arcs((pairs // self.size).astype(np.int32), (pairs % self.size).astype(np.int32))
            on = set(pairs[found].tolist())
            for x, y, z in zip(b.tolist(), e.tolist(), t.tolist(), strict=True):
                if int(last[x]) * self.size + z in on:
                    last[y], size[y] = z, y - x

    @staticmethod
    def _labels(starts, ends, last, size) -> tuple[np.ndarray, np.ndarray]:
        """The path to each word's end, followed back."""
        n = len(starts)
        words, found = [], []
        at, word = ends.copy(), np.arange(n)
        for _ in range(LOCKSTEP):
            if not len(at):
                break
            words.append(word)
            found.append(last[at])
            at = at - size[at]
            on = at > starts[word]
            at, word = at[on], word[on]
        for w, e in zip(word.tolist(), at.tolist(), strict=True):
            path = []
            while e > starts[w]:
                path.append(int(last[e]))
                e -= int(size[e])
            words.append(np.full(len(path), w))
            found.append(np.array(path, np.int32))
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        word, token = np.concatenate(words)[::-1], np.concatenate(found)[::-1]  # the last label came first
        return token[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        return self.encode_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0].tolist() if word else []

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by spaces, as the tokenizers library decodes where no decoder is set."""
        return " ".join([self.labels[i] for i in ids])


def _kinds() -> np.ndarray:
    """The kind of each code point, as the library's patterns see it."""
    kinds = np.full(0x110000, SIGN, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category[0] in "LN":
            kinds[code] = LETTER if category[0] == "L" else NUMBER
    for kind, ranges in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[WHITE] = SPACE
    kinds[HOLD : HOLD + 0x800] = SPECIAL
    return kinds


class TextEncoder:
    """Texts to tokens: special tokens, normalisation, word cutting, then the automaton.

    Reads a tokenizer file with NFC, white space and lower-case normalisation, the splitting
    pattern above, byte-level symbols, an end-of-word mark and no decoder; any other raises
    ValueError. Classes of characters, lower case and normalisation are those of the library.
    """

    def __init__(self, spec: str):
        file = json.loads(spec)
        model, plain = file["model"], {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
        odd += [k for k, v in (("normalizer", NORMALIZERS), ("pre_tokenizer", SPLITTING)) if list((file[k] or {}).values())[1:] != [v]]
        odd += [k for k in ("decoder",) if file.get(k)] + [t["content"] for t in file["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or odd:
            raise ValueError(f"a tokenizer file of another kind: {odd}")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenizationAutomaton(model["vocab"], merges, model["end_of_word_suffix"])
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.automaton.labels |= {i: t for t, i in special.items()}
        self.holds = {t: chr(HOLD + k) for k, t in enumerate(special)}
        self.special_ids = np.array(list(special.values()), np.int32)
        self.between = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.kinds = _kinds()
        names = [self.automaton.labels.get(i, "") for i in range(max(self.automaton.labels) + 1)]
        self.names, self.numbers = pa.array(names), pa.array(map(str, range(len(names))))

    def _normal(self, text: str) -> str:
        """Normalised text in which one surrogate stands for each special token."""
        if any(t in text for t in self.holds):
            return "".join([self.holds.get(p) or self._plain(p) for p in self.between.split(text)])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> str:
        if text.isascii():
            return text.lower()
        if _MARKS.search(text):
            text = "".join([unicodedata.normalize("NFC", part) for part in _MARKS.split(text)])
        else:
            text = unicodedata.normalize("NFC", text)
        return text.translate(_LOWERED).lower()

    def _word_starts(self, codes: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point; firsts are the places where texts start."""
        change = np.ones(len(codes), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
        change[firsts] = True
        starts = (change | (kinds == NUMBER) | (kinds == SPECIAL)) & (kinds != SPACE)
        marks = np.flatnonzero((codes == ord("'")) & starts)
        # an apostrophe and one of the endings are one word; what follows them is the next
        end_of_text = np.append(firsts, len(codes))[np.searchsorted(firsts, marks, side="right")] if len(marks) else marks
        for ending in ENDINGS:
            to = marks + 1 + len(ending)
            on = to <= end_of_text
            for k, letter in enumerate(ending):
                on[on] = codes[marks[on] + 1 + k] == ord(letter)
            starts[marks[on] + 1] = False
            after = to[on][to[on] < end_of_text[on]]
            starts[after] = kinds[after] != SPACE
        return starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        texts = [self._normal(t) for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        starts = self._word_starts(codes, kinds, edges[:-1][lengths > 0])
        kept = kinds != SPACE
        codes, starts = codes[kept], starts[kept]
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        at = np.flatnonzero(starts)
        firsts = np.searchsorted(at, np.concatenate([[0], np.cumsum(kept)])[edges])  # words before each text
        if len(data) > len(codes):
            at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])[at]
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        words = words.dictionary_encode()
        ids, offsets = self._distinct(words.dictionary)
        word = words.indices.to_numpy()
        counts = np.diff(offsets)[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids[np.repeat(offsets[word] - ends[:-1], counts) + np.arange(ends[-1])], ends[firsts]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and their offsets."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        ids, ends = self.automaton.encode_words(data[: offsets[-1]], offsets)
        lead = data[offsets[:-1]]
        held = np.flatnonzero(lead == 0xED)
        held = held[data[offsets[held] + 1] >= 0xA0]  # surrogates
        if len(held):
            counts = np.diff(ends)
            keep = np.ones(len(ids), bool)
            for w in held.tolist():
                keep[ends[w] + 1 : ends[w + 1]] = False
                ids[ends[w]] = self.special_ids[data[offsets[w] + 2] - 0x80]
            counts[held] = 1
            ids, ends = ids[keep], np.concatenate([[0], np.cumsum(counts)])
        return ids, ends

    def parts(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Rows, ids and offsets of the ids of parts of about PART_CHARS; a longer text is cut at white space into several."""
        rows, part, held = [], [], 0
        for row, text in enumerate(texts):
            for piece in _pieces(text or ""):
                if part and held + len(piece) > PART_CHARS:
                    yield rows, *self.encode(part)
                    rows, part, held = [], [], 0
                rows.append(row)
                part.append(piece)
                held += len(piece)
        if part:
            yield rows, *self.encode(part)

    def strings(self, ids: np.ndarray, offsets: np.ndarray, of: pa.Array) -> list[str]:
        """For each text the entries of its ids in of, joined by spaces."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of.take(pa.array(ids))), " ").to_pylist()

    def ids(self, text: str) -> list[int]:
        return np.concatenate([found for _, found, _ in self.parts([text])]).tolist()


def _pieces(text: str) -> Iterator[str]:
    """A text cut at the last white space before every PART_CHARS, or the first after."""
    while len(text) > PART_CHARS:
        cut = next((i for i in range(PART_CHARS, PART_CHARS // 2, -1) if ord(text[i]) in _WHITE), None)
        if cut is None:
            after = WHITE_SIGN.search(text, PART_CHARS)
            if after is None:
                break
            cut = after.start()
        yield text[:cut]
        text = text[cut:]
    yield text


_WHITE = frozenset(WHITE)
_encoders: dict[str, TextEncoder] = {}


def _encoder(spec: str, key: str) -> TextEncoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(spec)
    return _encoders[key]


def _broadcast(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    return spark.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest()


def encode(documents: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Every row with two more columns: ids (array<int>) and decoded (string).

    Null and empty texts have no ids and decode to the empty string; very long texts are
    encoded whole, in pieces. Columns of documents named ids or decoded are replaced; all
    others pass through, repeated rows repeat, and an empty table gives an empty table.
    """
    spec, key = _broadcast(documents.sparkSession, tokenizer_path)
    rest = documents.drop("ids", "decoded")
    place = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value, key)
        for whole in batches:
            for a, b in chunks(column_bytes(whole.column(place))[1], PART_CHARS):
                batch = whole.slice(a, b - a)
                counts, flat, decoded = np.zeros(b - a, np.int64), [], [""] * (b - a)
                for rows, ids, offsets in encoder.parts(batch.column(place).to_pylist()):
                    np.add.at(counts, rows, np.diff(offsets))
                    flat.append(ids)
                    for row, names in zip(rows, encoder.strings(ids, offsets, encoder.names), strict=True):
                        decoded[row] = f"{decoded[row]} {names}" if decoded[row] and names else decoded[row] or names
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(decoded, pa.string())], [*batch.schema.names, "ids", "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    return rest.mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Every row with a column decoded: the labels of its ids, joined by spaces.

    Null ids decode to null, none to ''. A column named decoded is replaced; repeated rows repeat.
    """
    spec, key = _broadcast(rows.sparkSession, tokenizer_path)
    rest = rows.drop("decoded")
    place = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _encoder(spec.value, key).automaton
        for batch in batches:
            decoded = [None if ids is None else automaton.decode(ids) for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    return rest.mapInArrow(run, f"{fields}, decoded string")


def digests(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, and SHA-256 of the ids as text and of the decoded text, both made in one pass.

    Null counts as empty: 0 tokens and the digests of the empty string. Very long texts are
    digested piece by piece. Repeated rows repeat, other columns are dropped, and an empty
    table gives an empty table.
    """
    spec, key = _broadcast(documents.sparkSession, tokenizer_path)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value, key)
        for whole in batches:
            for a, b in chunks(column_bytes(whole.column(1))[1], PART_CHARS):
                counts = [0] * (b - a)
                sums = [(hashlib.sha256(), hashlib.sha256()) for _ in counts]
                for rows, ids, offsets in encoder.parts(whole.column(1).slice(a, b - a).to_pylist()):
                    found = zip(rows, np.diff(offsets).tolist(), encoder.strings(ids, offsets, encoder.numbers), encoder.strings(ids, offsets, encoder.names), strict=True)
                    for row, n, *joined in found:
                        for digest, text in zip(sums[row], joined, strict=True):
                            digest.update((" " + text if counts[row] and n else text).encode())
                        counts[row] += n
                columns = [whole.column(0).slice(a, b - a), pa.array(counts, pa.int64()), *(pa.array([s[k].hexdigest() for s in sums]) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
