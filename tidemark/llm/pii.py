"""Operator 4: personal data by patterns and a skip-chain conditional random field.

Base spans follow fixed patterns. Patterns fail where entities stand side by side: a phone
number and a card number with a space between them are one run of digits that passes no test.
The field decides such cases token by token. Its tokens are runs without white space; their
potentials are linear in features of the token and its neighbours, consecutive labels share a
transition, and all tokens of a document that repeat or resemble each other, however far
apart, share a hub: a hidden kind that each of them favours. Loopy message passing runs over
chain and hubs until the messages settle. A token without digit and "@" can only be outside,
so it sends no message on; the chain falls into runs of the others.

The field learns from base spans themselves, on at most SAMPLE distinct texts, or stretches of
those longer than STRETCH characters, chosen by a hash of the text; digits that a failed match
covers teach nothing. Training is piecewise: unary, transition and shared potentials are
fitted each by its own likelihood, and only finding runs the messages. Spans of the field are
added where they have the form of their kind, pass its test and overlap no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textscan import column_bytes

KINDS = ["email", "ip", "card", "phone"]
#: The labels of a token; card and phone may go on over several tokens.
LABELS = ["outside", "email", "ip", "card", "phone", "card+", "phone+"]
KIND_OF = [-1, 0, 1, 2, 3, 2, 3]
SAMPLE = 3_000
STEPS, RATE, DECAY = 250, 0.1, 1e-3
STRETCH = 20_000  # characters of a training text; longer ones give several
TINY = 1e-200  # keeps messages above zero
SETTLED = 1e-6  # messages that change by no more are done
ROUNDS = 400  # of messages at most
STALE, FALLEN = 8, 0.9  # rounds in which the largest change has not fallen to that share before messages are damped more
DAMPED = 0.875  # at most
PIECE = 65_536  # tokens whose features are held at a time

# The base patterns.
EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_SIGNS = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+" + EMAIL_END.pattern)
FORMS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE_START, _EDGE_END = "\"'([{<,;:!?", "\"')]}>,;:!?."
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The test of a kind on a matched text."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern before their tests."""
    at, end = text.find("@"), 0
    while at >= 0:
        # no sign of the local part is an "@", so the match starts where the run of signs does
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL_END.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans that pass their tests, by kind and start, and the bounds of matches that fail."""
    kept, failed = [], []
    for kind, a, b in _matches(text):
        if passes(kind, text[a:b]):
            kept.append((kind, a, b))
        elif kind != "card" or b - a > 3:
            failed.append((a, b))
    return kept, failed


FEATURES = ["bias", "at", "at_domain", "digit_share", "digits_1_3", "digits_4_7", "digits_8_15", "digits_16_19", "digits_more", "luhn", "dots_3", "quad", "plus", "plus_short", "parentheses", "parentheses_3", "dash", "dash_3_4", "letters", "equals", "quote", "length"]


def _features(core: str) -> list[float]:
    digits = sum(c.isdigit() and c.isascii() for c in core)
    number = re.sub("[^0-9]", "", core)
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    return [
        1.0, "@" in core, bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", core)), digits / max(1, len(core)),
        1 <= digits <= 3, 4 <= digits <= 7, 8 <= digits <= 15, 16 <= digits <= 19, digits > 19, 16 <= digits <= 19 and luhn(number),
        core.count(".") == 3, quad and all(len(p) <= 4 and int(p) <= 255 for p in parts), core.startswith("+"), bool(re.fullmatch(r"\+[0-9]{1,3}", core)),
        "(" in core or ")" in core, bool(re.fullmatch(r"\(?[0-9]{3}\)", core)), "-" in core, bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", core)),
        any(c.isalpha() for c in core), "=" in core, '"' in core or "'" in core, min(len(core), 40) / 40,
    ]


def _cores(text: str) -> Iterator[tuple[int, int, int]]:
    """Bounds of each candidate token without edge punctuation, and its number among all tokens."""
    for n, m in enumerate(_TOKEN.finditer(text)):
        word = m[0]
        if "@" not in word and not any("0" <= c <= "9" for c in word):
            continue
        a, b = m.span()
        while a < b and text[a] in _EDGE_START and not (text[a] == "(" and ")" in word):
            a += 1
        while a < b and text[b - 1] in _EDGE_END and not (text[b - 1] == ")" and "(" in word):
            b -= 1
        if a < b:
            yield a, b, n


class Tokens:
    """The candidate tokens of one text: bounds, chain links and hubs; features are made piece by piece."""

    def __init__(self, text: str):
        self.text = text
        flat = np.fromiter((x for token in _cores(text) for x in token), np.int64).reshape(-1, 3)
        self.spans = flat[:, :2]
        self.linked = np.zeros(len(flat), bool)  # whether the next token is a candidate as well
        self.linked[:-1] = flat[1:, 2] == flat[:-1, 2] + 1
        # tokens alike but for case and separators have one key; keys of several tokens have a hub
        keys = [re.sub(r"[^a-z0-9@]", "", text[a:b].lower()) for a, b in self.spans.tolist()]
        number: dict[str, int] = {}
        of = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
        several = np.bincount(of, minlength=len(number)) > 1
        self.hub = np.where(several[of], (np.cumsum(several) - 1)[of], -1) if len(of) else of
        self.hubs = int(several.sum())

    @property
    def chain(self) -> list[int]:
        """The tokens that are linked to the next one."""
        return np.flatnonzero(self.linked).tolist()

    def own_features(self, a: int, b: int) -> np.ndarray:
        return np.array([_features(self.text[x:y]) for x, y in self.spans[a:b].tolist()], float).reshape(-1, len(FEATURES))

    def features(self) -> np.ndarray:
        """The features of each token, of the linked token before it and of the one after it; for short texts."""
        own = self.own_features(0, len(self.spans))
        before, after = np.zeros_like(own), np.zeros_like(own)
        after[:-1][self.linked[:-1]] = own[1:][self.linked[:-1]]
        before[1:][self.linked[:-1]] = own[:-1][self.linked[:-1]]
        return np.hstack([own, before, after])

    def potentials(self, unary: np.ndarray) -> np.ndarray:
        """features() @ unary, with the features of PIECE tokens at a time."""
        width, n = len(FEATURES), len(self.spans)
        out = np.zeros((n, unary.shape[1]))
        for a in range(0, n, PIECE):
            own = self.own_features(a, min(a + PIECE, n))
            b = a + len(own)
            out[a:b] += own @ unary[:width]
            ahead = own[: b - a - (b == n)] @ unary[width : 2 * width] * self.linked[a : b - (b == n), None]
            out[a + 1 : a + 1 + len(ahead)] += ahead
            back = own[a == 0 :] @ unary[2 * width :] * self.linked[a - (a > 0) : b - 1, None]
            out[b - 1 - len(back) : b - 1] += back
        return out


def labels_of(tokens: Tokens, spans: list[tuple[str, int, int]], failed: list[tuple[int, int]]) -> list[int]:
    """A label for each token from base spans; -1 for tokens that only a failed match covers."""
    out = []
    for a, b in tokens.spans.tolist():
        label = 0
        for kind, s, e in spans:
            if s < b and a < e:
                k = KINDS.index(kind)
                label = k + 1 if a <= s or k < 2 else k + 3
                break
        if not label and any(s < b and a < e for s, e in failed):
            label = -1
        out.append(label)
    return out


class SkipChain:
    """Weights of the field's potentials."""

    def __init__(self, unary: np.ndarray, transition: np.ndarray, skip: float):
        self.unary, self.transition, self.skip = unary, transition, skip

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Label beliefs of each token by message passing over chain and hubs, until no message changes by more than SETTLED."""
        return self.beliefs(tokens.potentials(self.unary), tokens.linked, tokens.hub, tokens.hubs)

    def beliefs(self, local: np.ndarray, linked: np.ndarray, hub: np.ndarray, hubs: int) -> np.ndarray:
        """Beliefs of n tokens with log potentials local; linked: to the next; hub: of each token, -1 for none."""
        own = np.exp(local - local.max(axis=1, keepdims=True)) + TINY
        one = np.flatnonzero(linked)
        held = np.flatnonzero(hub >= 0)
        step = np.exp(self.transition)
        # a hub has one state for each kind, and one for outside
        favour = np.where(np.array(KIND_OF)[:, None] == np.arange(-1, len(KINDS))[None, :], np.exp(self.skip), 1.0)
        ahead, back = np.ones((len(one), own.shape[1])), np.ones((len(one), own.shape[1]))
        down = np.ones((len(held), own.shape[1]))
        of = hub[held]

        def gathered() -> np.ndarray:
            out = own.copy()
            out[one + 1] *= ahead
            out[one] *= back
            out[held] *= down
            return out / out.sum(axis=1, keepdims=True) + TINY

        if not len(one) and not len(held):
            return gathered()
        kept, least, stale = 0.0, np.inf, 0  # share of the last messages that stays in the new ones
        for self.rounds in range(1, ROUNDS + 1):
            all_in = gathered()
            up = np.log(_unit((all_in[held] / down) @ favour))
            total = np.stack([np.bincount(of, up[:, k], hubs) for k in range(up.shape[1])], axis=1)
            rest = total[of] - up
            new = [
                _unit((all_in[one] / back) @ step),
                _unit((all_in[one + 1] / ahead) @ step.T),
                _unit(np.exp(rest - rest.max(axis=1, keepdims=True)) @ favour.T),
            ]
            change = max(np.abs(x - y).max() if len(x) else 0.0 for x, y in zip(new, (ahead, back, down), strict=True))
            if change <= SETTLED:
                ahead, back, down = new
                break
            least, stale = (change, 0) if change < FALLEN * least else (least, stale + 1)
            if stale == STALE:  # loops keep messages swinging
                kept, least, stale = min((1 + kept) / 2, DAMPED), np.inf, 0
            ahead, back, down = ((1 - kept) * x + kept * y for x, y in zip(new, (ahead, back, down), strict=True))
        return gathered()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of the most likely labels that pass their tests."""
        tokens = Tokens(text)
        if not len(tokens.spans):
            return []
        best = self.marginals(tokens).argmax(axis=1)
        if not best.any():
            return []
        out: list[tuple[str, int, int]] = []
        i = 0
        while i < len(best):
            j = i + 1
            if best[i] in (3, 4):
                while j < len(best) and tokens.linked[j - 1] and best[j] == best[i] + 2:
                    j += 1
            if 0 < best[i] < 5:
                kind, a, b = KINDS[KIND_OF[best[i]]], int(tokens.spans[i, 0]), int(tokens.spans[j - 1, 1])
                if FORMS[kind].fullmatch(text, a, b) and passes(kind, text[a:b]):
                    out.append((kind, a, b))
            i = j
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True) + TINY


def fit(texts: list[str]) -> SkipChain:
    """Fit on the base spans of texts, piecewise: unary, transition and shared potentials each by its own likelihood."""
    k, width = len(LABELS), 3 * len(FEATURES)
    rows, labels = [np.zeros((0, width))], []
    transition = np.full((k, k), 0.1)
    same, pairs = 9.0, 10.0  # a prior that tokens alike have the same kind
    for text in texts:
        tokens = Tokens(text)
        own = labels_of(tokens, *base_spans(text))
        rows.append(tokens.features())
        labels += own
        for i in tokens.chain:
            if own[i] >= 0 and own[i + 1] >= 0:
                transition[own[i], own[i + 1]] += 1
        last: dict[int, int] = {}
        for j in np.flatnonzero(tokens.hub >= 0).tolist():
            i = last.get(int(tokens.hub[j]))
            last[int(tokens.hub[j])] = j
            if i is not None and own[i] >= 0 and own[j] >= 0:
                same += KIND_OF[own[i]] == KIND_OF[own[j]]
                pairs += 1
    x, y = np.concatenate(rows), np.array(labels, int)
    x, y = x[y >= 0], y[y >= 0]
    weights = np.zeros((width, k))
    if len(y):
        hot = np.eye(k)[y]
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, STEPS + 1):
            p = x @ weights
            p = np.exp(p - p.max(axis=1, keepdims=True))
            g = x.T @ (hot - p / p.sum(axis=1, keepdims=True)) / len(y) - DECAY * weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights = weights + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # how much more often than by their own frequencies two labels follow each other
    lift = np.log(transition / transition.sum()) - np.log(transition.sum(1, keepdims=True) / transition.sum()) - np.log(transition.sum(0, keepdims=True) / transition.sum())
    # a label that goes on needs one that it goes on from
    for label, begins in ((5, 3), (6, 4)):
        forbidden = [i for i in range(k) if i not in (begins, label)]
        lift[forbidden, label] = -8.0
    share = min(max(same / pairs, 0.5), 0.99)
    return SkipChain(weights, np.clip(lift, -8, 4), float(np.log(share / (1 - share))))


def _candidates(column: pa.Array) -> np.ndarray:
    """Whether each text has a digit or an "@"."""
    data, offsets = column_bytes(column)
    total = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    return total[offsets[1:]] > total[offsets[:-1]]


def _stretches(text: str) -> Iterator[str]:
    """The text in parts of at most STRETCH characters, cut at blanks and line ends where there are any."""
    a = 0
    while len(text) - a > STRETCH:
        b = max(text.rfind(" ", a + 1, a + STRETCH), text.rfind("\n", a + 1, a + STRETCH))
        b = b if b > a else a + STRETCH
        yield text[a:b]
        a = b
    yield text[a:]


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """Hash and text of those stretches that have candidate tokens."""
    for i in np.flatnonzero(_candidates(batch.column(0))):
        for part in _stretches(batch.column(0)[i].as_py()):
            if re.search("[0-9@]", part):
                yield int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big", signed=True), part


def train(documents: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SkipChain:
    """Fit on at most sample distinct stretches with a digit or "@"; those with the smallest hashes."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, np.int64)
        for batch in batches:
            found = np.unique(np.concatenate([found, np.array([h for h, _ in _hashed(batch)], np.int64)]))[:sample]
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["hash"])

    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    last = texts.mapInArrow(smallest, "hash long").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    if last is None:
        return fit([])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = {h: part for h, part in _hashed(batch) if h <= last and h not in seen}
            seen |= found.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["hash", "text"])

    rows = texts.mapInArrow(chosen, "hash long, text string").groupBy("hash").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: r["hash"])])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(documents: DataFrame, model: SkipChain | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them.

    Positions are code points of the whole text, ends exclusive. Null and empty texts have no
    spans: counts 0, the digest of the empty string, spans ''. Added spans overlap no base span;
    the counts and the digest are of base spans alone. Repeated rows give repeated results, an
    empty table an empty one; of labels that are equally likely the first counts. Very long
    texts are read whole, with the features of PIECE tokens in memory at a time. Only the id
    and text columns are read.
    """
    model = model or train(documents, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = documents.schema[id_col].dataType.simpleString()
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((n, len(KINDS)), np.int64)
            digests, spans = [nothing] * n, [""] * n
            for i in np.flatnonzero(_candidates(batch.column(1))).tolist():
                text = batch.column(1)[i].as_py()
                base = base_spans(text)[0]
                for kind, _, _ in base:
                    counts[i, KINDS.index(kind)] += 1
                added = [s for s in field.spans(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]
                digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined(base + added)
            names = [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(digests), pa.array(spans)], names)

    fields = ", ".join(f"n_{k} long" for k in KINDS)
    return documents.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, {fields}, base_sha256 string, spans string")
