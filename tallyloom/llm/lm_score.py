"""Masked pseudo-likelihood: a network that predicts every word from the words on both sides scores documents.

Words are the ASCII-lower-cased runs between ASCII white space, as UTF-8 bytes. The `OWN` most frequent words of the corpus are leaves of their own; the others share
`BUCKETS` leaves by their last two bytes. The network reads the `REACH` words before and the `REACH` words behind a masked word (or the text's edge): the sum of their
vectors, weighted by place, goes through tanh, and a softmax over `CLASSES` classes of leaves and one over the `MEMBERS` leaves of a class give the probability of
every leaf. So every word's conditional comes from the network. P(word | leaf) is one for a leaf of its own; in a shared leaf it is the share of the word's last two bytes times
a byte-bigram model that spells the rest of the word from its end, both counted over all such words of the corpus.

What the corpus gives: the counts of all words (the biases start from them) and the training. Each task trains on its own texts, from the same start, by Adagrad on
every word as target, a third of them in each of `ROUNDS` rounds; then the parameters of all tasks are averaged in Spark, weighted by targets. So
training grows with the corpus, while what reaches the driver (one set of parameters, the vocabulary, two tables of 65,536 counts) doesn't.
Words are turned into leaves once; rounds and scoring read that table.

A document's score is the sum over its words of log P(word | its sides), the pseudo-log-likelihood. Null and empty texts have no words and score 0.0 (mean 0.0). Repeated
rows get equal scores. Very long texts are scored in parts, with their sides. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_arrow

MEMBERS, OWN_CLASSES, BUCKET_CLASSES = 96, 96, 32
CLASSES = OWN_CLASSES + BUCKET_CLASSES
OWN, BUCKETS = MEMBERS * OWN_CLASSES, MEMBERS * BUCKET_CLASSES
LEAVES = OWN + BUCKETS
EDGE = LEAVES  # beyond a text
REACH, WIDTH = 3, 16
EVERY, ROUNDS, BATCH, RATE = 1, 3, 8192, 0.15
#: Distinct words that a task holds before it sends their counts on, and words that it keeps the leaves of.
HELD, KEPT_WORDS = 300_000, 400_000
#: Words that are scored at a time; parts in which parameters are averaged, first those of one task in SALTS, so that no part's averages meet in one task at once.
SCORED, PARTS, SALTS = 8_192, 16, 64
#: Words whose logits are worked out together.
CACHED = 1024
ROWS, ONES = np.arange(CACHED), np.ones(CACHED, np.float32)
#: Memory that each batch uses again, by name: to touch new pages takes longer than most of the sums that go into them.
SCRATCH: dict[str, np.ndarray] = {}


def scratch(name: str, *shape: int) -> np.ndarray:
    """An array of the shape with any content, which holds until the next call by this name."""
    n = math.prod(shape)
    if name not in SCRATCH or SCRATCH[name].size < n:
        SCRATCH[name] = np.empty(n, np.float32)
    return SCRATCH[name][:n].reshape(shape)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over the whole corpus."""

    def work(batches):
        held: Counter[bytes] = Counter()
        for b in batches:
            for x in b.column(1).to_pylist():
                held.update(words_of(x))
            if len(held) >= HELD:
                yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})
                held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})

    return in_arrow(texts(docs), "word binary, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


def bucket_of(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % BUCKETS


def pairs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each with a zero before it, as pairs (byte before * 256 + byte), and how many pairs each word has."""
    flat = np.frombuffer(b"\x00" + b"\x00".join(words), dtype=np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    whole = flat[:-1] * 256 + flat[1:]
    starts = np.cumsum(size + 1) - (size + 1)
    return np.delete(whole, starts[1:] - 1), size  # without the pairs that lead from one word to the next


@dataclass
class Spelling:
    """log P(last two bytes | bucket), by pair, and log P(byte before | byte), by pair; a zero is the word's edge."""

    ending: np.ndarray
    before: np.ndarray

    def __call__(self, words: list[bytes]) -> np.ndarray:
        pairs, size = pairs_of(words)
        last = np.cumsum(size) - 1
        out = np.add.reduceat(self.before[pairs], np.cumsum(size) - size) - self.before[pairs[last]]
        return out + self.ending[pairs[last]]


def spelling(counts: np.ndarray, endings: np.ndarray) -> Spelling:
    """From how often each pair stands in the words of the buckets, and how often at their end."""
    smooth = counts.reshape(256, 256) + 0.01
    before = np.log(smooth / smooth.sum(axis=0, keepdims=True)).ravel()
    a, b = np.divmod(np.arange(65536), 256)
    bucket = np.array([bucket_of(bytes([x, y]) if x else bytes([y])) - OWN for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    smooth = endings + 0.01
    return Spelling(np.log(smooth / np.bincount(bucket, smooth, BUCKETS)[bucket]), before)


@dataclass
class Words:
    own: dict[bytes, int]
    spelling: Spelling
    shares: np.ndarray  # of the leaves in the corpus


class Reader(dict):
    """Words to their places in the tables leaf and rest (log P(word | leaf)), which hold the words met so far."""

    def __init__(self, words: Words):
        super().__init__()
        self.words, self.new = words, []
        self.leaf, self.rest = np.zeros(0, np.uint16), np.zeros(0)

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at

    def __call__(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > KEPT_WORDS:
            self.clear()
            self.leaf, self.rest = self.leaf[:0], self.rest[:0]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.int64)
        if self.new:
            own = np.fromiter((self.words.own.get(w, -1) for w in self.new), np.int64, len(self.new))
            others = np.flatnonzero(own < 0)
            rest = np.zeros(len(own))
            if len(others):
                spelled = [self.new[i] for i in others.tolist()]
                own[others], rest[others] = list(map(bucket_of, spelled)), self.words.spelling(spelled)
            self.leaf, self.rest, self.new = np.append(self.leaf, own.astype(np.uint16)), np.append(self.rest, rest), []
        return self.leaf[at], self.rest[at]


def leaves(docs: DataFrame, words: Words) -> DataFrame:
    """doc_id, n_words, leaves (two bytes each), rest (the sum of log P(word | leaf))."""

    def work(batches):
        reader = Reader(words)
        for b in batches:
            lists = [words_of(x) for x in b.column(1).to_pylist()]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            leaf, rest = reader(lists)
            ends = np.cumsum(size)
            blobs = [leaf[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            total = np.bincount(np.repeat(np.arange(len(lists)), size), rest, len(lists))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()), pa.array(total, pa.float64())], ["doc_id", "n_words", "leaves", "rest"])

    return in_arrow(texts(docs), "doc_id long, n_words long, leaves binary, rest double", work)


def with_edges(lists: list[np.ndarray]) -> np.ndarray:
    edge = np.full(REACH, EDGE, dtype=np.int64)
    return np.concatenate([x for one in lists for x in (edge, one)] + [edge])


def windows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of all texts with REACH edges before each and behind the last, the places of the words in them, and each word's text."""
    size = np.array([len(x) for x in lists], dtype=np.int64)
    owner = np.repeat(np.arange(len(lists)), size)
    return with_edges(lists), np.arange(size.sum()) + REACH * (owner + 1), owner


OFFSETS = np.array([*range(-REACH, 0), *range(1, REACH + 1)])


@dataclass
class Network:
    vectors: np.ndarray  # of the leaves and the edge
    places: np.ndarray  # weights of the sides
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    members: np.ndarray  # class x width x member
    member_bias: np.ndarray

    def hidden(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """And the vectors of the sides, which hold until the next call."""
        x = np.take(self.vectors, sides, axis=0, out=scratch("sides", *sides.shape, WIDTH), mode="clip")
        h = np.einsum("nod,od->nd", x, self.places)
        h += self.bias
        return np.tanh(h, out=h), x

    def log_p(self, sides: np.ndarray, leaf: np.ndarray, slopes: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """log P(leaf | sides); into slopes, if given, goes the gradient of its mean, with the sign of a loss."""
        n = len(leaf)
        h, x = self.hidden(sides)
        own, member = np.divmod(leaf.astype(np.uint16), np.uint16(MEMBERS))
        order = np.argsort(own, kind="stable")  # by radix: 16 bits
        own, member = own[order], member[order]
        h1 = scratch("h1", n, WIDTH + 1)
        h1[:, :-1], h1[:, -1] = h[order], 1  # the last number meets the bias
        classes = np.concatenate([self.classes, self.class_bias[None]])
        members = np.concatenate([self.members, self.member_bias[:, None]], axis=1, out=scratch("members", CLASSES, WIDTH + 1, MEMBERS))
        found, of_h1 = np.empty(n, np.float32), scratch("of_h1", n, WIDTH + 1)

        def settle(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
            """log P of the leaves at these columns; the logits become their gradient, if one is asked for."""
            rows = ROWS[: len(at)]
            picked = logit[rows, at]
            np.exp(logit, out=logit)
            total = logit @ ONES[: logit.shape[1]]
            if slopes is not None:
                logit *= (1 / (total * n))[:, None]
                logit[rows, at] -= 1 / n
            return picked - np.log(total)

        of_classes, of_members = np.zeros_like(classes), None if slopes is None else np.zeros_like(members)
        logits = scratch("logits", n, MEMBERS)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if n else np.zeros(0, np.int64)
        runs = list(zip(starts.tolist(), [*starts[1:].tolist(), n], own[starts].tolist(), strict=True))
        for a, e, k in runs:
            np.matmul(h1[a:e], members[k], out=logits[a:e])
        for i in range(0, n, CACHED):  # few enough that their logits stay in the cache
            here, k = h1[i : i + CACHED], own[i : i + CACHED]
            logit = np.matmul(here, classes, out=scratch("logit", len(here), CLASSES))
            found[i : i + CACHED] = settle(logit, k) + settle(logits[i : i + CACHED], member[i : i + CACHED])
            if slopes is not None:
                of_classes += here.T @ logit
                np.matmul(logit, classes.T, out=of_h1[i : i + CACHED])
        out = np.empty(n, np.float32)
        out[order] = found
        if slopes is not None:
            for a, e, k in runs:
                np.matmul(h1[a:e].T, logits[a:e], out=of_members[k])
                of_h1[a:e] += logits[a:e] @ members[k].T
            slopes["classes"], slopes["class_bias"] = of_classes[:-1], of_classes[-1]
            slopes["members"], slopes["member_bias"] = of_members[:, :-1], of_members[:, -1]
            of_h = np.empty_like(h)
            of_h[order] = of_h1[:, :-1]
            of_h *= 1 - h * h
            slopes["bias"], slopes["places"] = of_h.sum(axis=0), np.einsum("nd,nod->od", of_h, x)
            leaf_of = sides.ravel().astype(np.uint16)
            order = np.argsort(leaf_of, kind="stable")
            leaf_of = leaf_of[order]
            starts = np.flatnonzero(np.append(True, leaf_of[1:] != leaf_of[:-1]))
            slopes["vectors"] = np.zeros_like(self.vectors)
            word, place = np.divmod(order, 2 * REACH)
            of_x = np.take(of_h, word, axis=0, out=scratch("of_x", len(order), WIDTH), mode="clip")
            of_x *= np.take(self.places, place, axis=0, out=scratch("places", len(order), WIDTH), mode="clip")
            slopes["vectors"][leaf_of[starts]] = np.add.reduceat(of_x, starts, axis=0, out=scratch("sums", len(starts), WIDTH))
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    def with_flat(self, values: np.ndarray) -> Network:
        out, at = {}, 0
        for k, x in vars(self).items():
            out[k], at = values[at : at + x.size].reshape(x.shape).copy(), at + x.size
        return replace(self, **out)


def start(shares: np.ndarray, seed: int = 3) -> Network:
    """A network that gives each leaf its share of the corpus, whatever the sides."""
    g = np.random.default_rng(seed)
    table = shares.reshape(CLASSES, MEMBERS)
    of_class = table.sum(axis=1)
    normal = lambda *shape: g.standard_normal(shape).astype(np.float32)
    return Network(normal(LEAVES + 1, WIDTH) * np.float32(0.3), np.ones((2 * REACH, WIDTH), np.float32), np.zeros(WIDTH, np.float32), normal(WIDTH, CLASSES) * np.float32(0.05), np.log(of_class).astype(np.float32), normal(CLASSES, WIDTH, MEMBERS) * np.float32(0.05), np.log(table / of_class[:, None]).astype(np.float32))


class Learner:
    """Adagrad from a given network."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.seen = replace(net, **{k: x.copy() for k, x in vars(net).items()}), rate, 0
        self.squares = {k: np.full_like(x, 1e-6) for k, x in vars(net).items()}

    def step(self, sides: np.ndarray, leaf: np.ndarray) -> None:
        slopes: dict[str, np.ndarray] = {}
        self.net.log_p(sides, leaf, slopes)
        self.seen += len(leaf)
        for k, g in slopes.items():
            square, move = np.multiply(g, g, out=scratch("square", *g.shape)), scratch("move", *g.shape)
            self.squares[k] += square
            np.multiply(g, self.rate, out=move)
            move /= np.sqrt(self.squares[k], out=square)
            getattr(self.net, k).__isub__(move)


def targets(lists: list[np.ndarray], turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Sides and leaves of the words that are targets in a round: of each text every (EVERY * ROUNDS)-th word, each time others."""
    flat, size, step = with_edges(lists), np.array([len(x) for x in lists], dtype=np.int64), EVERY * ROUNDS
    first = (turn * EVERY - size) % step
    count = np.maximum(0, -(-(size - first) // step))
    begin = np.cumsum(size + REACH) - size + first
    places = np.repeat(begin - step * (np.cumsum(count) - count), count) + step * np.arange(count.sum())
    return flat[places[:, None] + OFFSETS], flat[places]


def one_round(ids: DataFrame, net: Network, turn: int) -> Network:
    """Each task learns from its own texts; the average of what they learned."""
    cuts = np.linspace(0, net.flat().size, PARTS + 1).astype(int)

    def learn(batches):
        learner, sides, leaf = Learner(net, RATE / (1 + turn)), [], []
        for b in batches:
            lists = [np.frombuffer(x, np.uint16).astype(np.int64) for x in b.column(0).to_pylist()]
            s, t = targets(lists, turn)
            sides, leaf = [*sides, s], [*leaf, t]
            if sum(map(len, leaf)) >= BATCH:
                s, t = np.concatenate(sides), np.concatenate(leaf)
                whole = len(t) // BATCH * BATCH
                for i in range(0, whole, BATCH):
                    learner.step(s[i : i + BATCH], t[i : i + BATCH])
                sides, leaf = [s[whole:]], [t[whole:]]
        if sum(map(len, leaf)):
            learner.step(np.concatenate(sides), np.concatenate(leaf))
        if learner.seen:
            learned, salt = learner.net.flat(), TaskContext.get().partitionId() % SALTS
            for i in range(PARTS):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([learner.seen], pa.int64()), pa.array([learned[cuts[i] : cuts[i + 1]].tobytes()], pa.binary())], names)

    def average(batches):
        total, seen = {}, Counter()
        for b in batches:
            for i, salt, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[i, salt] = total.get((i, salt), 0) + n * np.frombuffer(x, np.float32).astype(np.float64)
                seen[i, salt] += n
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in total], pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([seen[k] for k in total], pa.int64()), pa.array([(x / seen[k]).astype(np.float32).tobytes() for k, x in total.items()], pa.binary())], names)

    schema, names = "part int, salt int, seen long, learned binary", ["part", "salt", "seen", "learned"]
    some = in_arrow(in_arrow(ids.select("leaves"), schema, learn).repartition("part", "salt"), schema, average)  # of some tasks each
    rows = in_arrow(some.repartition("part"), schema, average).collect()  # PARTS rows
    if not rows:
        return net
    return net.with_flat(np.concatenate([np.frombuffer(r["learned"], np.float32) for r in sorted(rows, key=lambda r: r["part"])]))


def vocabulary(docs: DataFrame) -> Words:
    counts = durable(word_counts(docs))
    # a histogram of the counts tells below which size no word of the vocabulary lies, so that tasks send few others
    step = F.floor(F.log2("n") * 8)
    least, reached = 0, 0
    for size, n in sorted(((r["size"], r["n"]) for r in counts.groupBy(step.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True):
        least, reached = size, reached + n
        if reached >= OWN:
            break
    top = [(bytes(r["word"]), r["n"]) for r in counts.where(step >= least).orderBy(F.desc("n"), "word").limit(OWN).collect()]
    own = {w: i for i, (w, _) in enumerate(top)}

    def totals(batches):  # of the words of the buckets: by leaf, by pair of bytes, by last pair
        out = np.zeros(BUCKETS + 2 * 65536, np.int64)
        for b in batches:
            n = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            words = [w for w in n if w not in own]
            if not words:
                continue
            times = np.fromiter((n[w] for w in words), np.int64, len(words))
            pairs, size = pairs_of(words)
            out[:BUCKETS] += np.bincount(np.fromiter(map(bucket_of, words), np.int64, len(words)) - OWN, times, BUCKETS).astype(np.int64)
            out[BUCKETS : BUCKETS + 65536] += np.bincount(pairs, np.repeat(times, size), 65536).astype(np.int64)
            out[BUCKETS + 65536 :] += np.bincount(pairs[np.cumsum(size) - 1], times, 65536).astype(np.int64)
        keys = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out[keys], pa.int64())], ["key", "n"])

    summed = in_arrow(counts, "key int, n long", totals).groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS + 2 * 65536 rows
    got = np.zeros(BUCKETS + 2 * 65536)
    got[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
    shares = np.full(LEAVES, 0.5)
    shares[: len(top)] += [n for _, n in top]
    shares[OWN:] += got[:BUCKETS]
    return Words(own, spelling(got[BUCKETS : BUCKETS + 65536], got[BUCKETS + 65536 :]), shares / shares.sum())


@dataclass
class Model:
    words: Words
    net: Network


def train(ids: DataFrame, shares: np.ndarray) -> Network:
    net = start(shares)
    for turn in range(ROUNDS):
        net = one_round(ids, net, turn)
    return net


def build(docs: DataFrame) -> Model:
    words = vocabulary(docs)
    return Model(words, train(durable(leaves(docs, words)), words.shares))


def score_leaves(ids: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum), mean_log_likelihood."""

    def work(batches):
        for b in batches:
            flat, places, owner = windows([np.frombuffer(x, np.uint16).astype(np.int64) for x in b.column(2).to_pylist()])
            size, total = b.column(1).to_numpy(), b.column(3).to_numpy().copy()
            for i in range(0, len(places), SCORED):
                at = places[i : i + SCORED]
                total += np.bincount(owner[i : i + SCORED], net.log_p(flat[at[:, None] + OFFSETS], flat[at]), len(total))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.float64()), pa.array(total / np.maximum(size, 1), pa.float64())], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return in_arrow(ids, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double", work)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return score_leaves(leaves(docs, model.words), model.net)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    words = vocabulary(docs)
    ids = durable(leaves(docs, words))
    return score_leaves(ids, train(ids, words.shares))
