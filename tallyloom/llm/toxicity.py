"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input: the lower-cased words of a text (cut at white space, outer punctuation off). A word is the sum of its own vector, if it is in the vocabulary of the
training sample, and of the mean vector of its hashed character 3- and 4-grams, so that inflected and unseen words are read by their letters.
Windows of `WINDOW` words, each `STRIDE` words on, overlap by half and cover the whole text, so every passage of up to WINDOW - STRIDE + 1 words lies whole in one of them. Two gated recurrent layers read a window from either side,
attention pools their states, and a linear unit gives the window's logit. A text is as toxic as its worst window; its score is a logistic
function of that logit, calibrated on the training sample.

Training sees a bounded sample (`Fit.per_class` texts of each label of at most `Fit.max_bytes` bytes). Of a toxic text, only the window with the highest logit
counts as toxic (at first, the one with the highest sum of n-gram log-odds); of other texts, all windows are clean.

Null and empty texts have one empty window, and get its score. Repeated rows get equal scores. An empty table gives no rows. Without labels of both kinds, every
text gets the share of toxic labels (0.0 without any). Other columns are never read; one that is named like the score is replaced by it.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, in_arrow, labelled_texts

WINDOW, STRIDE = 32, 16
GRAMS, DIM, HIDDEN, ATTENTION = 1 << 14, 12, 8, 8
OUTER = ".,;:!?()[]{}\"'«»„“”‘’*#$%&|_-…"
#: Words of which a task keeps the input vectors at a time.
KEPT_WORDS = 200_000


@dataclass(frozen=True)
class Fit:
    per_class: int = 2000
    max_bytes: int = 8000
    steps: int = 330
    batch: int = 192
    rate: float = 0.01
    seed: int = 7


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words, word after word, and how many each word has (one at least)."""
    coded = [f"<{w}>" if w else "<>>" for w in words]
    raw = np.frombuffer("".join(coded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    last = np.repeat(np.cumsum(size), size)  # where the word of each character ends
    at = np.arange(len(raw))
    padded = np.append(raw, np.zeros(3, np.uint64))
    word = np.repeat(np.arange(len(words)), size)
    index, owner = [], []
    for n in (3, 4):
        h = np.full(len(raw), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ padded[k : k + len(raw)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = at + n <= last
        index.append((h[whole] % np.uint64(GRAMS)).astype(np.int64))
        owner.append(word[whole])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(index)[order], np.bincount(np.concatenate(owner), minlength=len(words))


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(count) - count, axis=0) if len(count) else values[:0]


def window_rows(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (windows x WINDOW, -1 beyond the end) and the text of each window, for texts that lie in ids from starts to ends; no words: one empty window."""
    n = ends - starts
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner][:, None] + turn[:, None] * STRIDE + np.arange(WINDOW)
    inside = at < ends[owner][:, None]
    padded = np.append(ids, -1)
    return np.where(inside, padded[np.where(inside, at, len(ids))], -1), owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters p; tables of input vectors come from outside, as rows that windows refer to (-1: no word)."""

    def __init__(self, vocabulary: list[str], seed: int):
        g = np.random.default_rng(seed)
        of = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.p = {"word": zero(len(vocabulary) + 1, DIM), "gram": (g.standard_normal((GRAMS, DIM)) * 0.3).astype(np.float32), "v": of(ATTENTION), "a": of(2 * HIDDEN, ATTENTION), "ab": zero(ATTENTION), "o": of(2 * HIDDEN), "ob": zero(1)}
        for d in "fb":
            self.p |= {f"w{d}": of(DIM, 3 * HIDDEN), f"u{d}": of(HIDDEN, 3 * HIDDEN), f"c{d}": zero(3 * HIDDEN)}
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], dtype=np.int64)

    def vectors(self, words: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        """words: numbers in the vocabulary; flat, count: from grams()."""
        return sums(self.p["gram"][flat], count) / count[:, None].astype(np.float32) + self.p["word"][words]

    def forward(self, inputs: dict[str, np.ndarray], rows: np.ndarray, keep: bool = False):
        """Logits of windows; inputs: for each direction a table of word vector @ w + c, with a last row for no word."""
        n, mask, p, past = len(rows), rows >= 0, self.p, {}
        both = np.empty((n, WINDOW, 2 * HIDDEN), np.float32)
        columns, full = np.ascontiguousarray(rows.T), mask.all(axis=0)
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                x, u = inputs[d].take(columns[t], axis=0, mode="wrap"), h @ p[f"u{d}"]
                gates = x[:, : 2 * HIDDEN]
                gates += u[:, : 2 * HIDDEN]
                gates *= 0.5
                gates = np.tanh(gates)
                gates += 1
                gates *= 0.5
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = r * u[:, 2 * HIDDEN :]
                new += x[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                if keep:
                    past[d, t] = (h, z, r, new, u[:, 2 * HIDDEN :], mask[:, t, None])
                now = h - new
                now *= z
                now += new
                h = now if full[t] else np.where(mask[:, t, None], now, h)
                both[:, t, side] = h
        e = both.reshape(-1, 2 * HIDDEN) @ p["a"]
        e += p["ab"]
        e = np.tanh(e, out=e).reshape(n, WINDOW, -1)
        s = np.where(mask, e @ p["v"], -1e9)
        s = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        alpha = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.matmul(alpha[:, None, :].astype(np.float32), both)[:, 0]
        logit = pooled @ p["o"] + p["ob"][0]
        return (logit, (both, e, alpha, pooled, past)) if keep else logit

    def tables(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        padded = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
        return {d: padded @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, vectors: np.ndarray, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted logistic loss: by parameter, and by input vector."""
        p = self.p
        inputs, mask = self.tables(vectors), rows >= 0
        logit, (both, e, alpha, pooled, past) = self.forward(inputs, rows, keep=True)
        out = (sigmoid(logit) - target) * weight / weight.sum()
        g = {"o": pooled.T @ out, "ob": np.array([out.sum()], np.float32)}
        of_pooled = out[:, None] * p["o"]
        of_both = alpha[:, :, None] * of_pooled[:, None, :]
        of_alpha = (both * of_pooled[:, None, :]).sum(axis=2)
        of_s = alpha * (of_alpha - (alpha * of_alpha).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", of_s, e)
        of_e = of_s[:, :, None] * p["v"] * (1 - e * e)
        g["a"], g["ab"] = np.einsum("nth,nta->ha", both, of_e), of_e.sum(axis=(0, 1))
        of_both = of_both + of_e @ p["a"].T
        of_vectors = np.zeros((len(vectors) + 1, DIM), np.float32)
        for d, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            of_h, of_u, steps = np.zeros((len(rows), HIDDEN), np.float32), np.zeros_like(p[f"u{d}"]), np.zeros((len(rows), WINDOW, 3 * HIDDEN), np.float32)
            for t in order:
                h, z, r, new, un, m = past[d, t]
                of_h = of_h + of_both[:, t, side]
                of_new = of_h * (1 - z) * (1 - new * new) * m
                of_z = of_h * (h - new) * z * (1 - z) * m
                of_r = of_new * un * r * (1 - r)
                of_x = np.hstack([of_z, of_r, of_new])
                of_gate = np.hstack([of_z, of_r, of_new * r])
                of_u += h.T @ of_gate
                steps[:, t] = of_x
                of_h = np.where(m, of_h * z, of_h) + of_gate @ p[f"u{d}"].T
            g[f"u{d}"] = of_u
            of_in = scatter(np.where(mask, rows, len(vectors)).ravel(), steps.reshape(-1, 3 * HIDDEN), len(vectors) + 1)
            padded = np.vstack([vectors, np.zeros((1, DIM), np.float32)])
            g[f"w{d}"], g[f"c{d}"] = padded.T @ of_in, of_in[:-1].sum(axis=0)
            of_vectors += of_in @ p[f"w{d}"].T
        return g, of_vectors[:-1]


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            p[k] -= (self.rate * m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def scatter(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], size) for k in range(values.shape[1])], axis=1).astype(np.float32)


def fit(texts: list[str], labels: list[int], how: Fit = Fit()) -> Network:
    y = np.array(labels, dtype=np.float32)
    one: dict[str, str] = {}  # each word is held once
    docs = [[one.setdefault(w, w) for w in (w.strip(OUTER) for w in words_of(t))] for t in texts]
    seen = Counter(w for d in docs for w in set(d))
    net = Network(sorted(w for w, n in seen.items() if n >= 3)[:50_000], how.seed)
    if not 0 < y.sum() < len(y):
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    names = sorted(seen)
    number = {w: i for i, w in enumerate(names)}
    ids = np.array([number[w] for d in docs for w in d], dtype=np.int64)
    ends = np.cumsum([len(d) for d in docs])
    rows, owner = window_rows(ids, np.concatenate([[0], ends[:-1]]), ends)
    flat, count = grams(names)
    begins, numbers = np.cumsum(count) - count, net.numbers(names)

    def grams_of(some: np.ndarray) -> np.ndarray:
        n = count[some]
        return flat[np.repeat(begins[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    # first guess of the toxic windows: n-grams that are commoner in toxic texts
    toxic, clean = np.zeros(GRAMS), np.zeros(GRAMS)
    for d, k in zip(docs, labels, strict=True):
        if d:
            (toxic if k else clean)[np.unique(grams_of(np.array([number[w] for w in set(d)])))] += 1
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    by_word = np.append(sums((np.maximum(0.0, odds - 1) ** 2)[flat], count) / count, 0.0)
    guess = by_word[rows].max(axis=1)
    rng, adam, bad = np.random.default_rng(how.seed), Adam(how.rate), np.flatnonzero(y[owner] > 0)
    clean_rows = np.flatnonzero(y[owner] == 0)

    def worst(value: np.ndarray, among: np.ndarray) -> np.ndarray:
        order = among[np.lexsort((-value[among], owner[among]))]
        return order[np.unique(owner[order], return_index=True)[1]]

    def logits() -> np.ndarray:
        inputs = net.tables(net.vectors(numbers, flat, count))
        return np.concatenate([net.forward(inputs, rows[i : i + 1024]) for i in range(0, len(rows), 1024)])

    positive, hard = worst(guess, bad), worst(guess, clean_rows)
    for step in range(how.steps):
        if step in (how.steps // 3, how.steps * 2 // 3):
            now = logits()
            positive, hard = worst(now, bad), worst(now, clean_rows)
        third = how.batch // 3
        pick = np.concatenate([rng.choice(positive, third), rng.choice(hard, third), rng.choice(clean_rows, third)])
        used, local = np.unique(rows[pick], return_inverse=True)
        local = local.reshape(len(pick), WINDOW)
        if used[0] == -1:
            used, local = used[1:], local - 1
        if not len(used):
            continue
        part, n = grams_of(used), count[used]
        g, of_vectors = net.gradients(net.vectors(numbers[used], part, n), local, y[owner[pick]], np.ones(len(pick), np.float32))
        g["gram"] = scatter(part, np.repeat(of_vectors / n[:, None], n, axis=0), GRAMS)
        g["word"] = scatter(numbers[used], of_vectors, len(net.vocabulary) + 1)
        g["word"][-1] = 0
        adam.rate = how.rate * (1 - 0.9 * step / how.steps)
        adam.step(net.p, g)
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, logits())
    # calibration: both labels count alike
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    a, b = 1.0, 0.0
    for _ in range(200):
        error = (1 / (1 + np.exp(-np.clip(a * top + b, -30, 30))) - y) * weight
        a, b = max(0.05, a - 0.5 * ((error * top).sum() + 1e-3 * a)), b - 0.5 * error.sum()
    net.scale, net.shift = float(a), float(b)
    return net


class Scorer:
    """Scores texts; keeps the input vectors of words met so far, up to KEPT_WORDS."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.inputs = net.tables(np.zeros((0, DIM), np.float32))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        docs = [words_of(t) for t in texts]
        met = set().union(*docs)
        new = list(met - self.known.keys())
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, new = {}, list(met)
        if new:
            first, last = len(self.known), len(self.known) + len(new)
            self.known.update(zip(new, range(first, last), strict=True))
            bare = [w.strip(OUTER) for w in new]
            for d, made in self.net.tables(self.net.vectors(self.net.numbers(bare), *grams(bare))).items():
                if last >= len(self.inputs[d]):
                    self.inputs[d] = np.vstack([self.inputs[d][:first], np.empty((2 * last - first, made.shape[1]), np.float32)])
                self.inputs[d][first:last], self.inputs[d][-1] = made[:-1], made[-1]
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), dtype=np.int64)
        ends = np.cumsum([len(d) for d in docs])
        rows, owner = window_rows(ids, np.concatenate([[0], ends[:-1]]), ends)
        top = np.full(len(docs), -np.inf)
        for i in range(0, len(rows), 2048):
            np.maximum.at(top, owner[i : i + 2048], self.net.forward(self.inputs, rows[i : i + 2048]))
        return 1 / (1 + np.exp(-np.clip(self.net.scale * top + self.net.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, how: Fit = Fit()) -> Network:
    """Trained in a task: the sample's texts and the states of training never come to the driver, only the network does."""
    sample = labelled_texts(docs, labels, "toxic", F.lit(True) if learn_from is None else learn_from, how.per_class, how.max_bytes)

    def work(batches):
        texts, known = [], []
        for b in batches:
            known += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, known, how))], pa.binary())], ["net"])

    one = sample.repartition(1).sortWithinPartitions("label", "rank", "doc_id").select("label", "text")
    nets = in_arrow(one, "net binary", work).collect()
    return pickle.loads(nets[0]["net"]) if nets else fit([], [], how)


def score(docs: DataFrame, net: Network, carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns to carry (default: all) and the score, a double from 0 to 1."""
    carry = beside(docs.columns if carry is None else carry, name)
    schema = docs.select(*carry, F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def work(batches):
        scorer = Scorer(net)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(scorer(b.column(at).to_pylist()), pa.float64())], [*carry, name])

    return in_arrow(docs, schema, work)
