"""Personal data: pattern matches, and what a skip-chain conditional random field adds to them.

The field's nodes are the tokens that have a digit or an @; every other token is clamped to "outside", which cuts
the chain exactly there. Neighbouring nodes share transition potentials; equal and similar tokens anywhere in a
document are joined, each to its next occurrence, by skip potentials. Tokens of pattern matches are observed.
Loopy sum-product messages then carry their labels to the tokens that the patterns missed, in all documents of a
batch at once. Weights are trained piecewise: node potentials by multinomial logistic regression, transitions and
skips from how often neighbours and repeats agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Fixed patterns and limits of the base matches.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Documents that weights are trained on, about: the bound of the training sample.
TRAIN_DOCS = 4000
#: Rounds of messages, and the marginal from which a label is added.
ROUNDS = 12
SURE = 0.8
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
#: The same matches as the patterns give, found in linear time: an address by its @, and an ip only where digits begin.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.S)
_NOT_DIGIT = re.compile(r"[^0-9]")
_NOT_WORD = re.compile(r"[^0-9a-z]")
_LAST_WORD = re.compile(r"([^\W\d_]+)\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    if kind == "email":
        return True
    digits = _NOT_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _addresses(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            out += [(k, *span) for span in _addresses(text)]
        elif kind != "phone" or "+" in text:
            out += [(k, m.start(), m.end()) for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text) if _valid(kind, m.group())]
    return out


def has_candidates(text: str) -> bool:
    return "@" in text or any(d in text for d in "0123456789")


def _shape(core: str) -> str:
    """Letters as a, digits as 9 with the length of their run."""
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", core))


def tokens_of(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, core, whether it follows the one before directly) of the tokens with a digit or an @."""
    out, before = [], None
    for m in CANDIDATE.finditer(text):
        core = _CORE.search(m.group())
        if core:
            out.append((m.start() + core.start(), m.start() + core.end(), core.group(), before is not None and not text[before : m.start()].strip() and m.start() - before <= 2))
        before = m.end()
    return out


def features_of(text: str, tokens: list) -> list[list[str]]:
    shapes, out = [_shape(t[2]) for t in tokens], []
    for i, (start, _, core, joined) in enumerate(tokens):
        digits = _NOT_DIGIT.sub("", core)
        parts = core.split(".")
        f = ["bias", f"shape={shapes[i]}", f"digits={min(len(digits), 20)}"]
        if "@" in core:
            f.append("at")
            if PATTERNS["email"].fullmatch(core):
                f.append("address")
        if core[0] == "+":
            f.append("plus")
        if 16 <= len(digits) <= 19 and len(digits) == len(core):
            f.append(f"luhn={luhn(digits)}")
        if len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts):
            f.append(f"octets={all(int(p) <= 255 for p in parts)}")
        if joined:
            f.append(f"before={shapes[i - 1]}")
        else:
            word = _LAST_WORD.search(text[max(0, start - 30) : start])
            f.append(f"word={word[1].lower() if word else ''}")
        if i + 1 < len(tokens) and tokens[i + 1][3]:
            f.append(f"after={shapes[i + 1]}")
        out.append(f)
    return out


def observed(tokens: list, spans: list) -> list[int]:
    """Label of each token that a span covers, else 0."""
    out = []
    for start, end, _, _ in tokens:
        out.append(next((k + 1 for k, s, e in spans if s < end and start < e and min(e, end) - max(s, start) >= 0.6 * (end - start)), 0))
    return out


def skip_edges(tokens: list) -> list[tuple[int, int]]:
    """Each token and the next one that is equal but for punctuation and case, or alike in its first three fifths."""
    last: dict[str, int] = {}
    out = set()
    for i, (_, _, core, _) in enumerate(tokens):
        key = _NOT_WORD.sub("", core.lower())
        keys = [f"={key}"] if len(key) >= 4 else []
        if len(key) >= 8:
            keys.append(f"~{len(key)}:{key[: len(key) * 3 // 5]}")
        for k in keys:
            if k in last:
                out.add((last[k], i))
            last[k] = i
    return sorted(out)


class Field:
    """Weights of the field: node weights by feature and label, transition scores, and the score of agreement."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, skip: float):
        self.index, self.weights, self.transitions, self.skip = index, weights, transitions, skip

    @classmethod
    def train(cls, texts: list[str], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-4) -> Field:
        rows, labels, chains, agree = [], [], np.ones((5, 5)), [1.0, 1.0]
        for text in texts:
            tokens = tokens_of(text)
            got = observed(tokens, base_spans(text))
            rows += features_of(text, tokens)
            labels += got
            for i in range(1, len(tokens)):
                if tokens[i][3]:
                    chains[got[i - 1], got[i]] += 1
            for i, j in skip_edges(tokens):
                if got[i] or got[j]:
                    agree[got[i] == got[j]] += 1
        times: dict[str, int] = {}
        for f in rows:
            for x in f:
                times[x] = times.get(x, 0) + 1
        index = {x: i for i, x in enumerate(sorted(x for x, n in times.items() if n >= 3))}
        expected = chains.sum(1, keepdims=True) * chains.sum(0, keepdims=True) / chains.sum()
        transitions = np.clip(np.log(chains / expected), -2, 2)
        field = cls(index, np.zeros((len(index) + 1, 5)), transitions, float(np.clip(np.log(agree[1] / agree[0]), 0.5, 3)))
        if not rows or not any(labels):
            field.weights[-1, 0] = 20.0  # nothing to learn from: all is outside
            return field
        flat, at = field._flat(rows)
        gold = np.eye(5)[labels]
        square = np.zeros_like(field.weights)
        for _ in range(rounds):  # full-batch adaptive gradient
            score = field._scores(flat, at, len(rows))
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - gold) / len(rows)
            grad = np.stack([np.bincount(flat, error[at, k], len(field.weights)) for k in range(5)], 1) + ridge * field.weights
            square += grad * grad
            field.weights -= rate * grad / (np.sqrt(square) + 1e-8)
        return field

    def _flat(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature indices of all rows in one array, and the row of each. The last weight is every row's."""
        flat, at = [], []
        for i, f in enumerate(rows):
            own = [self.index[x] for x in f if x in self.index]
            flat += own + [len(self.index)]
            at += [i] * (len(own) + 1)
        return np.array(flat, np.int64), np.array(at, np.int64)

    def _scores(self, flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, self.weights[flat, k], n) for k in range(5)], 1)

    def marginals(self, rows: list[list[str]], clamp: list[int], chain: list[tuple[int, int]], skip: list[tuple[int, int]]) -> np.ndarray:
        """Label marginals of the nodes of any number of documents by loopy sum-product; clamp: observed labels, 0 for none."""
        n = len(rows)
        unary = self._scores(*self._flat(rows), n)
        unary -= unary.max(1, keepdims=True)
        fixed = np.flatnonzero(clamp)
        unary[fixed] = -30.0
        unary[fixed, np.array(clamp)[fixed]] = 0.0
        same = np.where(np.eye(5, dtype=bool), self.skip, 0.0)
        same[0, 0] = 0.0  # repeats outside say nothing
        ends = np.array(chain + skip, np.int64).reshape(-1, 2)
        if len(ends):
            pair = np.concatenate((np.broadcast_to(self.transitions, (len(chain), 5, 5)), np.broadcast_to(same, (len(skip), 5, 5))))
            source = np.concatenate((ends[:, 0], ends[:, 1]))
            target = np.concatenate((ends[:, 1], ends[:, 0]))
            pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
            m, back = np.zeros((len(source), 5)), np.concatenate((np.arange(len(ends)) + len(ends), np.arange(len(ends))))
            for _ in range(ROUNDS):
                belief = unary + np.stack([np.bincount(target, m[:, k], n) for k in range(5)], 1)
                out = (belief[source] - m[back])[:, :, None] + pair
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                m = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
            unary = unary + np.stack([np.bincount(target, m[:, k], n) for k in range(5)], 1)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def label_batch(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, as (kind, start, end) by kind and start."""
    rows, clamp, chain, skip, docs = [], [], [], [], []
    for text in texts:
        if not has_candidates(text):
            docs.append(([], [], 0))
            continue
        spans, tokens, at = base_spans(text), tokens_of(text), len(rows)
        rows += features_of(text, tokens)
        clamp += observed(tokens, spans)
        chain += [(at + i - 1, at + i) for i in range(1, len(tokens)) if tokens[i][3]]
        skip += [(at + i, at + j) for i, j in skip_edges(tokens)]
        docs.append((spans, tokens, at))
    p = field.marginals(rows, clamp, chain, skip) if rows else np.empty((0, 5))
    best = p.argmax(1)
    label = np.where((best > 0) & (p[np.arange(len(p)), best] >= SURE), best, 0).tolist()
    out = []
    for spans, tokens, at in docs:
        added, held = [], None
        for i, (start, end, _, joined) in enumerate(tokens):
            k = label[at + i]
            if k and held and joined and held[0] == k and k in (4, 3) and held[2] is not None:
                held[2] = end
            elif k:
                held = [k, start, end]
                added.append(held)
            else:
                held = None
        new = [(k - 1, s, e) for k, s, e in added if not any(b < e and s < f for _, b, f in spans)]
        out.append((spans, sorted(spans + new)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def train_field(docs: DataFrame, limit: int = TRAIN_DOCS) -> Field:
    """Weights from about ``limit`` distinct texts with a digit or an @, drawn by hash.

    Each drawn text is searched whole; every candidate in it goes to the driver, with 40 characters on both sides, which
    is all that features and labels look at.
    """
    some = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    n = some.count()
    if not n:
        return Field.train([])
    drawn = (F.xxhash64(F.lit("pii"), "text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)) < min(1.0, limit / n)
    texts = some.where(drawn).dropDuplicates(["text"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the surroundings of candidates go to the driver: what features and labels see
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                keep, end = [], -1
                for m in CANDIDATE.finditer(text):
                    a, b = max(0, m.start() - 40), m.end() + 40
                    if a <= end:
                        keep[-1] += text[end:b]
                    else:
                        keep.append(text[a:b])
                    end = max(end, b)
                out.append(" \n ".join(keep))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    return Field.train(sorted(r["text"] for r in texts.mapInArrow(lean(lines), "text string").collect()))


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added for every row of docs (doc_id, text).

    A null text is empty: counts of 0 and no spans. Rows are labelled one by one, so repeated and null ids stay.
    Texts are read whole; positions are code points. Added spans never overlap base spans.
    """
    field = field or train_field(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(i, 1000), []
                found = label_batch(shared.value, [t or "" for t in part.column("text").to_pylist()])
                for doc_id, (base, spans) in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    counts = [sum(k == j for k, _, _ in base) for j in range(4)]
                    rows.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(lean(run), ddl)
