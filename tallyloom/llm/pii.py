"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from one pattern per kind (email, ip, card, phone), leftmost and without overlaps of its own kind; a match that fails its test is dropped. Then the
tokens with a digit or an at sign become nodes of a random field over the labels none, email, ip, card, phone. Tokens in a base span are
observed with its kind. The others have potentials from their shape. Neighbours in
the text are linked, and so are each two successive tokens of a document that are equal, or alike (the same last seven digits, or the same name before the at
sign): the skip edges, by which all mentions of one thing get one label. The weights of shapes and of both kinds of edges are trained together, on the base spans of a bounded sample of texts, by
pseudo-likelihood: each token's label given its shape and the labels of all tokens linked to it. Loopy belief
propagation runs for a fixed number of rounds; a token whose likeliest label is a kind with over half the belief becomes a span, joined with its neighbours of that kind.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows give equal rows; an empty table gives none. Without a token to learn
from, there are only base spans. Very long texts are read once: the work is linear in the text, edges are at most three per token. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, first_by_hash, in_arrow, text_bytes, texts_of

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
OUTER = ".,;:!?()[]{}<>\"'"
SAMPLE_TEXTS, SAMPLE_BYTES, ROUNDS, FEATURES = 3000, 8000, 6, 26


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from their at signs, so that long words cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


TOKEN = re.compile(r"[0-9@]+")


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that have a digit or an at sign, outer punctuation off."""
    out, end, n = [], 0, len(text)
    for m in TOKEN.finditer(text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        end = b
        while a < b and text[a] in OUTER:
            a += 1
        while b > a and text[b - 1] in OUTER:
            b -= 1
        out.append((a, b))
    return out


def shape(word: str, near: tuple[bool, bool]) -> list[int]:
    """Indexes of the features that hold."""
    digits = re.sub("[^0-9]", "", word)
    n, dots, at = len(digits), word.count("."), "@" in word
    out = [0, 1 + min(3, dots), 5 + (0 if n == 0 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 8 else 4 if n <= 11 else 5 if n <= 15 else 6 if n <= 19 else 7)]
    tests = (at, at and "." in word[word.find("@") :], word[:1] == "+", "(" in word or ")" in word, "-" in word, not any(c.isalpha() for c in word), any(c.isalpha() for c in word) and not at, n >= 12 and luhn(digits), near[0], near[1], dots == 3 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in word.split(".")), "_" in word or "/" in word, "=" in word)
    return out + [13 + i for i, x in enumerate(tests) if x]


@dataclass
class Document:
    spans: list[tuple[int, int, int]]
    at: list[tuple[int, int]]
    x: np.ndarray  # features
    seen: np.ndarray  # observed label or -1
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of equal or similar tokens


def read(text: str) -> Document:
    spans, at = base_spans(text), tokens(text)
    n = len(at)
    near = [False] + [text[at[i][1] : at[i + 1][0]].strip(OUTER + " ") == "" and at[i + 1][0] - at[i][1] <= 4 for i in range(n - 1)] + [False]
    x, seen, k = np.zeros((n, FEATURES), np.float32), np.full(n, -1), 0
    last, skip = {}, []
    reach = [0]
    for _, _, b in spans:
        reach.append(max(reach[-1], b))
    for i, (a, b) in enumerate(at):
        word = text[a:b]
        x[i, shape(word, (near[i], near[i + 1]))] = 1
        while k < len(spans) and reach[k + 1] <= a:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < b:
            if spans[j][2] > a:
                seen[i] = spans[j][1] + 1
                break
            j += 1
        low = word.lower()
        digits = re.sub("[^0-9]", "", low)
        for key in (("=", low), ("7", digits[-7:]) if len(digits) >= 7 else None, ("@", low.partition("@")[0]) if "@" in low[1:] else None):
            if key:
                if key in last:
                    skip.append((last[key], i))
                last[key] = i
    chain = [(i, i + 1) for i in range(n - 1) if near[i + 1]]
    pairs = lambda p: np.array(sorted(set(p)), dtype=np.int64).reshape(-1, 2)
    return Document(spans, at, x, seen, pairs(chain), pairs(skip))


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: float
    skip: float


def fit(texts: list[str], steps: int = 150, ridge: float = 1e-3) -> Field | None:
    docs = [d for d in map(read, texts) if d.at]
    if not docs:
        return None
    x = np.concatenate([d.x for d in docs])
    y = np.concatenate([np.maximum(d.seen, 0) for d in docs])
    starts = np.cumsum([0] + [len(d.at) for d in docs])

    def beside(kind: str) -> np.ndarray:
        """Of each token, how many of its neighbours have each label."""
        edges = np.concatenate([getattr(d, kind) + s for d, s in zip(docs, starts, strict=False)])
        out = np.zeros((len(x), 5))
        np.add.at(out, (edges[:, 0], y[edges[:, 1]]), 1)
        np.add.at(out, (edges[:, 1], y[edges[:, 0]]), 1)
        return out

    chain, skip = beside("chain"), beside("skip")
    goal, w = np.eye(5)[y], np.zeros(FEATURES * 5 + 2)
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        g = slope(w, x, chain, skip, goal) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(w[:-2].reshape(FEATURES, 5), float(np.clip(w[-2], 0.0, 4.0)), float(np.clip(w[-1], 0.0, 4.0)))


def conditional(w: np.ndarray, x: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """P(label | features, labels of the neighbours) of each token."""
    s = x @ w[:-2].reshape(FEATURES, 5) + w[-2] * chain + w[-1] * skip
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def slope(w: np.ndarray, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Gradient of the negative log-pseudo-likelihood, a token's mean."""
    off = conditional(w, x, chain, skip) - goal
    return np.concatenate([(x.T @ off).ravel(), [(off * chain).sum(), (off * skip).sum()]]) / len(x)


def beliefs(d: Document, field: Field) -> np.ndarray:
    node = d.x @ field.unary
    node -= node.max(axis=1, keepdims=True)
    node = np.exp(node)
    known = d.seen >= 0
    node[known] = np.eye(5)[d.seen[known]]
    node /= node.sum(axis=1, keepdims=True)
    edges = np.concatenate([d.chain, d.skip])
    if not len(edges):
        return node
    weight = np.exp(np.concatenate([np.full(len(d.chain), field.chain), np.full(len(d.skip), field.skip)]))
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    weight = np.concatenate([weight, weight])[:, None]
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    logs, message = np.log(node + 1e-12), np.zeros((len(source), 5))

    def together() -> np.ndarray:
        return logs + np.stack([np.bincount(target, message[:, k], len(node)) for k in range(5)], axis=1)

    for _ in range(ROUNDS):
        out = together()[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out = out.sum(axis=1, keepdims=True) + (weight - 1) * out  # equal labels count `weight` times
        message = np.log(out / out.sum(axis=1, keepdims=True))
    b = together()
    b = np.exp(b - b.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    if field is None:
        base = base_spans(text)
        return base, base
    d = read(text)
    if not d.at or (d.seen >= 0).all():
        return d.spans, d.spans
    b = beliefs(d, field)
    best = b.argmax(axis=1)
    found = (d.seen < 0) & (best > 0) & (b.max(axis=1) > 0.5)
    joined, added = {(int(i), int(j)) for i, j in d.chain}, []
    for i in np.flatnonzero(found):
        start, end = d.at[i]
        if start >= end:
            continue
        if added and (i - 1, i) in joined and found[i - 1] and best[i - 1] == best[i]:
            added[-1] = (added[-1][0], added[-1][1], end)
        else:
            added.append((start, int(best[i]) - 1, end))
    return d.spans, sorted(d.spans + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(docs: DataFrame) -> Field | None:
    rows = docs.where((text_bytes() <= SAMPLE_BYTES) & F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = durable(rows)
    chosen = [(r["doc_id"],) for r in first_by_hash(rows, SAMPLE_TEXTS, rows.count())]
    ids = docs.sparkSession.createDataFrame(chosen, rows.select("doc_id").schema)
    small = docs.where(text_bytes() <= SAMPLE_BYTES)
    return fit([r["text"] for r in texts_of(small, ids).orderBy("doc_id").collect()])


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]

    def work(batches):
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, every = all_spans(text or "", field)
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((d, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", work)
