"""Quality classifier by Bradley-Terry pairwise ranking.

A text becomes a row of features: of its bytes and words (lengths, shares, repeats, signs), and of its content, the square roots of the shares of its hashed byte 4-grams,
lower-cased, words and word edges included. All labelled texts, however long, are dealt by doc_id into blocks of some `BLOCK` texts. In each block preference pairs
(a text of quality 1 over one of quality 0) are drawn, `PAIRS_EACH` for each text; the score is linear in the features, and a block's weights minimise the logistic
loss of the feature differences of its pairs (Newton's method on the first kind, then gradient steps on all). The weights are the mean over the blocks, by texts; means and spreads of the features are those of all the texts.
So that every block has pairs, texts of a label with less than `BOTH` for each block stand in several blocks. The threshold is an exact quantile of the scores of all labelled texts: the one that leaves as many below it as there are of quality 0.
A text's score is the logistic function of its distance to the threshold, so 0.5 is the threshold.

A doc_id with both labels has label 1; of texts with one doc_id, the least is learned from.
Null and empty texts have all features of an empty text, and get its score. Repeated rows get equal scores. An empty table gives no rows. Without labels of both
kinds, every text gets the share of quality labels (1.0 without any). Other columns are never read; one that is named like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, in_arrow, row_numbers

PAIRS_EACH, SEED, STEPS = 4, 11, 150
#: Texts of a block (less than twice as many, if hashes spread evenly), and of each label in it.
BLOCK, BOTH = 4096, 64
#: Characters that are counted one by one.
SIGNS = b".,;:!?|#$%&*<>{}[]()/\\=_-+@\"'~^`"


GRAMS = 2048
#: Bytes of texts that are hashed at a time.
TOGETHER = 1 << 20
LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in range(256)], dtype=np.uint8)


def content(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of the hashed 4-grams of bytes, a space at each end."""
    n, count = len(text or b"") + 2, np.zeros(GRAMS, np.int64)
    raw = np.frombuffer(b" " + (text or b"") + b" ", dtype=np.uint8)
    for i in range(0, max(1, n - 3), TOGETHER):
        x = LOWER[raw[i : i + TOGETHER + 3]].astype(np.uint32)
        if len(x) > 3:
            word = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
            count += np.bincount((word * np.uint32(2654435761)) >> np.uint32(32 - 11), minlength=GRAMS)
    return np.sqrt(count / max(1, n - 3))


def features(text: bytes | None) -> np.ndarray:
    return np.concatenate([surface(text), content(text)]).astype(np.float32)


def surface(text: bytes | None) -> list[float]:
    raw = text or b""
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    distinct = len(set(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    same = sum(map(bytes.__eq__, words, words[1:]))
    ends = int(count[46] + count[33] + count[63])
    p = count[count > 0] / n
    share = lambda x: float(x) / n
    return [
        float(np.log1p(len(words))), float(np.log1p(len(raw))), distinct / w, same / w, float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())),
        ends / w, float(np.log1p(w / (ends + 1))), len(set(lines)) / len(lines), len(lines) / w, share(count[48:58].sum()), share(count[65:91].sum()), share(count[97:123].sum()),
        share(count[128:].sum()), share(count[32]), float(-(p * np.log(p)).sum()), float(np.log1p(n / w)), float(len(words) < 5), float(len(words) < 20),
        *[min(1.0, 20 * float(count[c]) / w) for c in SIGNS], *[float(count[c] > 0) for c in SIGNS],
    ]


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) - self.threshold, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Ranking:
    """The ranking of these texts alone."""
    if not len(y) or y.min() == y.max():
        return Ranking(np.zeros(1), np.ones(1), np.zeros(1), 0.0, float(y.mean()) if len(y) else 1.0)
    mean, spread = x.mean(axis=0, dtype=np.float64).astype(x.dtype), x.std(axis=0, dtype=np.float64).astype(x.dtype) + x.dtype.type(1e-6)
    z = np.clip((x - mean) / spread, -8, 8)
    rng, good, bad = np.random.default_rng(SEED), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better = np.concatenate([np.tile(good, PAIRS_EACH), rng.choice(good, len(bad) * PAIRS_EACH)])
    worse = np.concatenate([rng.choice(bad, len(good) * PAIRS_EACH), np.tile(bad, PAIRS_EACH)])
    own = x.shape[1] - GRAMS if x.shape[1] > GRAMS else x.shape[1]
    first = z[:, :own].astype(np.float64)
    d = first[better] - first[worse]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method
        lost = 1 / (1 + np.exp(np.clip(d @ w[:own], -30, 30)))
        slope = d.T @ lost / len(d) - ridge * w[:own]
        curve = (d * (lost * (1 - lost))[:, None]).T @ d / len(d) + ridge * np.eye(own)
        step = np.linalg.solve(curve, slope)
        w[:own] += step * min(1.0, 4.0 / (np.linalg.norm(step) + 1e-9))
        if np.linalg.norm(step) < 1e-6:
            break
    if own < x.shape[1]:
        m = v = 0.0
        for t in range(1, STEPS + 1):  # gradient steps: a pair's loss is spread over its two texts
            s = z @ w.astype(z.dtype)
            lost = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
            g = ridge * 10 * w - (np.bincount(better, lost, len(z)) - np.bincount(worse, lost, len(z))).astype(z.dtype) @ z / len(better)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.02 * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s, bad = np.sort(z @ w.astype(z.dtype)), len(bad)
    return Ranking(mean, spread, w, float(s[bad - 1] + s[bad]) / 2)


def learned(texts: DataFrame) -> DataFrame:
    """i, n, weight, mean, square: of each block and feature, the number of its texts, the weight, the mean and the mean square; texts: label, own (whether the text counts in this block), text."""

    def work(batches):
        x, y, own = [], [], []
        for b in batches:
            y += b.column(0).to_pylist()
            own += b.column(1).to_pylist()
            x += [features(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
        if not any(own) or min(y) == max(y):
            return
        x, own = np.array(x), np.array(own)
        mine = x if own.all() else x[own]
        of = [fit(x, np.array(y)).weights, mine.mean(axis=0, dtype=np.float64), np.einsum("ij,ij->j", mine, mine, dtype=np.float64) / len(mine)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(np.full(x.shape[1], len(mine)), pa.int64()), *map(pa.array, of)], ["i", "n", "weight", "mean", "square"])

    return in_arrow(texts.select("label", "own", "text"), "i int, n long, weight double, mean double, square double", work)


def blocks(docs: DataFrame, known: DataFrame, totals: dict[int, int]) -> DataFrame:
    """label, own, text of the known texts (doc_id, label), a partition for each block. Texts move once; if one label is rare, once more."""
    n, (few, rare) = max(1, sum(totals.values()) // BLOCK), min((count, k) for k, count in totals.items())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(n, "doc_id").join(known.repartition(n, "doc_id").hint("shuffle_hash"), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    if few >= BOTH * n:
        return texts.select("label", F.lit(True).alias("own"), "text")
    copies = min(n, -(-BOTH * n // few))
    turns = F.when(F.col("label") == rare, F.lit(copies)).otherwise(1)
    texts = texts.select("doc_id", "label", "text", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    block = F.pmod(F.xxhash64("doc_id") + F.col("turn") * (n // copies), F.lit(n)).cast("int")
    return texts.select("label", (F.col("turn") == 0).alias("own"), "text", block.alias("block")).repartitionById(n, "block")


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> Ranking:
    """From all labelled texts; what reaches the driver are one row for each feature, two totals and the two scores beside the threshold."""
    docs = (docs if learn_from is None else docs.where(learn_from)).select("doc_id", "text")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = durable(docs.select("doc_id").distinct().join(known, "doc_id"))
    totals = dict(known.groupBy("label").count().collect())
    if len(totals) < 2:
        return fit(np.zeros((len(totals), 1)), np.array(list(totals)))
    of = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    rows = sorted(learned(blocks(docs, known, totals)).groupBy("i").agg(of("weight"), of("mean"), of("square")).collect())
    _, weights, mean, square = map(np.array, zip(*rows, strict=True))
    ranking = Ranking(mean, np.sqrt(np.maximum(0, square - mean * mean)) + 1e-6, weights, 0.0)
    margins = durable(valued(docs, ranking.margin, ["doc_id"], "margin").join(known, "doc_id"))
    bad = margins.where("label = 0").count()
    beside_it = row_numbers(margins.select("margin", "doc_id"), ["margin", "doc_id"], "at").where(F.col("at").isin(bad, bad + 1)).collect()
    return replace(ranking, threshold=float(np.mean([r["margin"] for r in beside_it])))


def valued(docs: DataFrame, value: Callable[[np.ndarray], np.ndarray], carry: list[str], name: str) -> DataFrame:
    """The columns to carry and, under the name, the value of each text's features."""
    schema = docs.select(*carry, F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def work(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            values = value(np.array([features(x) for x in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(values, pa.float64())], [*carry, name])

    return in_arrow(docs, schema, work)


def score(docs: DataFrame, ranking: Ranking, carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns to carry (default: all) and the score, a double from 0 to 1."""
    return valued(docs, ranking, beside(docs.columns if carry is None else carry, name), name)
