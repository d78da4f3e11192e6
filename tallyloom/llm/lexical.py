"""Ranked lexical search by variable-block-max WAND.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased. With N the documents that have a term, L all their terms, n the terms of one
document, df the documents that hold a term and tf its occurrences in one, a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document has m = 10 + (90nN div L), and its score for an
item is the sum of w * ((1000000000 tf) div (1000 tf + 8m)) over the item's terms, once each. All else than w is integer arithmetic.

The index is a table with one row for each shard, a bounded number of postings of the documents of one input partition. In a shard, documents are numbered by length, so that
neighbours have similar scores. A term's postings are cut into blocks by dynamic programming: of all cuts into blocks of at most `BLOCK` postings (within pieces of `PIECE`), the one that
minimises the sum over postings of (block's maximum - own score) plus a price for each block, `PRICE` times the list's mean score. A block keeps its first and last document and its maximum.

A search adds up the maxima of an item's blocks between the points where any of them begins or ends: the bound of each such interval. Intervals are taken by falling bound, a few and then
more at once; only blocks that reach into a taken interval are read, and the search of the shard ends when the next bound is below the tenth best score so far. That score is carried from shard to
shard within a task, so later shards are mostly skipped. Equal bounds are read, since an equal score with a smaller doc_id wins. Nothing is approximate.

Each row of documents is a document and each row of items a query, whatever its id: repeated rows are found, and asked, repeatedly. Missing doc_ids come last among equal scores. Null and empty texts
have no terms: they count in neither N nor L, match nothing and ask nothing. Empty tables give no rows; other columns are ignored. Items are searched in parts of at most `most_items`, so
that what tasks are sent has a bound; every part goes over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_arrow, spans

#: Bytes of a term stay, A-Z in lower case; all others become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD, BLOCK, PIECE, PRICE = 1_000_000, 64, 512, 8
#: Postings that one task searches when there are many.
TASK = 20_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Statistics:
    documents: int
    terms: int
    weights: np.ndarray  # of the vocabulary's terms

    def lengths(self, n: list[int]) -> np.ndarray:
        return np.array([10 + 90 * x * self.documents // self.terms for x in n], dtype=np.int64)

    def scores(self, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def cuts(scores: np.ndarray, price: np.ndarray) -> np.ndarray:
    """For rows of scores (padded with zeros) the length of the best last block of every prefix, by dynamic programming over all rows at once."""
    rows, width = scores.shape
    most = min(BLOCK, width)
    far = np.int64(2**61)
    top, cost = np.zeros((rows, most), np.int64), np.full((rows, most), far)  # for a block of k+1 postings that ends here: its maximum, and the cost of all before it
    sizes, so_far, last, row = np.arange(1, most + 1), np.zeros(rows, np.int64), np.zeros((rows, width + 1), np.int64), np.arange(rows)
    for j in range(width):
        top[:, 1:] = top[:, :-1]
        top[:, 0] = 0
        np.maximum(top, scores[:, j : j + 1], out=top)
        cost[:, 1:] = cost[:, :-1]
        cost[:, 0] = so_far
        whole = cost + top * sizes
        best = whole.argmin(axis=1)
        so_far = whole[row, best] + price
        last[:, j + 1] = best + 1
    return last


def block_ends(scores: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Where the blocks of all lists end; lists are the offsets of the lists, their ends included."""
    size = np.diff(lists)
    pieces = -(-size // PIECE)
    of = np.repeat(np.arange(len(size)), pieces)
    start = lists[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stop = np.minimum(start + PIECE, lists[of + 1])
    sums = np.concatenate([[0], np.cumsum(scores)])
    price = PRICE * (sums[lists[of + 1]] - sums[lists[of]]) // size[of]
    ends = []
    for width in (4, 16, 64, PIECE):
        mine = np.flatnonzero((stop - start <= width) & (stop - start > {4: 0, 16: 4, 64: 16, PIECE: 64}[width]))
        for i in range(0, len(mine), 512):
            some = mine[i : i + 512]
            at = start[some, None] + np.arange(width)
            inside = at < stop[some, None]
            last = cuts(np.where(inside, scores[np.minimum(at, len(scores) - 1)], 0), price[some])
            here = stop[some] - start[some]
            row, base = np.arange(len(some)), start[some]
            while len(row):
                ends.append(base + here)
                here = here - last[row, here]
                left = here > 0
                row, base, here = row[left], base[left], here[left]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


class Shard:
    """Postings and blocks of some documents; made of one row of the index."""

    def __init__(self, doc_ids, known, lists, docs, scores, ends):
        self.doc_ids, self.known, self.docs, self.scores = doc_ids, known, docs, scores
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.ends = ends
        self.blocks = np.searchsorted(ends, lists, side="right") if len(ends) else np.zeros(len(lists), np.int64)  # of each term, by the offsets of its postings
        self.first, self.last = docs[self.begins].astype(np.int64), docs[ends - 1].astype(np.int64)
        self.bound = np.maximum.reduceat(scores, self.begins) if len(ends) else scores
        self.read = 0  # postings, so far

    def search(self, terms: np.ndarray, best: list[tuple], top: int) -> list[tuple]:
        """The best `top` of best and of this shard's documents, as (-score, doc_id is missing, doc_id)."""
        b = spans(self.blocks[terms], self.blocks[terms + 1])
        if not len(b):
            return best
        first, after, bound = self.first[b], self.last[b] + 1, self.bound[b]
        edges = np.concatenate([first, after])
        order = edges.argsort(kind="stable")
        edges = edges[order]
        bounds = np.cumsum(np.concatenate([bound, -bound])[order])[:-1]
        width = np.diff(edges)
        live = np.flatnonzero((width > 0) & (bounds > 0))
        live = live[(-bounds[live]).argsort(kind="stable")]
        begin, end = np.searchsorted(edges, first), np.searchsorted(edges, after)  # a block reaches over these intervals
        i, step = 0, top
        while i < len(live):
            least = -best[-1][0] if len(best) == top else 1
            left = int(np.searchsorted(-bounds[live[i:]], -least, side="right"))  # intervals that may hold such a score
            if not left:
                break
            some = live[i : i + min(step, left)]
            i, step = i + len(some), 4 * step
            taken = np.zeros(len(bounds) + 1, np.int64)
            taken[some] = 1
            before = np.concatenate([[0], np.cumsum(taken)])
            reach = np.flatnonzero(before[end] > before[begin])
            p = spans(self.begins[b[reach]], self.ends[b[reach]])
            self.read += len(p)
            docs = self.docs[p]
            inside = taken[np.searchsorted(edges, docs, side="right") - 1] > 0
            docs, scores = docs[inside], self.scores[p[inside]]
            found, which = np.unique(docs, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, which, scores)
            good = np.flatnonzero(total >= least)
            if len(good) > 8 * top:  # only scores up to the tenth best can stay
                good = good[total[good] >= np.partition(total[good], -top)[-top]]
            new = [(-int(total[g]), not self.known[found[g]], int(self.doc_ids[found[g]])) for g in good]
            best = sorted(best + new)[:top]
        return best


INDEX = "doc_ids array<bigint>, known array<boolean>, lists array<bigint>, docs array<int>, scores array<bigint>, ends array<bigint>"


def shard_row(documents: list[tuple], terms: list, tfs: list, statistics: Statistics) -> pa.RecordBatch:
    """One row of the index, of documents (doc_id, n) with their numbers of terms and occurrences."""
    order = sorted(range(len(documents)), key=lambda i: documents[i][1])
    m = statistics.lengths([documents[i][1] for i in order])
    doc = np.repeat(np.arange(len(order), dtype=np.int32), [len(terms[i]) for i in order])
    term, tf = np.concatenate([terms[i] for i in order]), np.concatenate([tfs[i] for i in order]).astype(np.int64)
    by = term.argsort(kind="stable")
    term, doc, tf = term[by], doc[by], tf[by]
    scores = statistics.scores(term, tf, m[doc])
    lists = np.searchsorted(term, np.arange(len(statistics.weights) + 1)).astype(np.int64)
    full = np.flatnonzero(np.diff(lists))
    ends = block_ends(scores, np.concatenate([lists[full], lists[-1:]]))
    ids = [documents[i][0] for i in order]
    columns = [np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids]), lists, doc, scores, ends]
    return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], [c.split()[0] for c in INDEX.split(", ")])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: the number of all terms of each document, and those of the vocabulary with their occurrences."""

    def work(batches):
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return in_arrow(rows, "doc_id long, n long, terms array<int>, tfs array<int>", work)


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The shards' rows, for the terms of the vocabulary (a number for each, from 0 without gaps), whose lists alone are held. N, L and df are counted over all documents."""
    rows = durable(counted(docs, vocabulary))
    whole = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # as many as the vocabulary has
    weights = [math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    statistics = Statistics(whole["documents"], whole["terms"], np.array(weights, np.int64))
    tasks = max(-(-whole["postings"] // TASK), 2 * docs.sparkSession.sparkContext.defaultParallelism)

    def work(batches):
        documents, terms, tfs, size = [], [], [], 0
        for b in batches:
            for doc, n, t, f in zip(*[b.column(k) for k in range(4)], strict=True):
                documents.append((doc.as_py(), n.as_py()))
                terms.append(t.values.to_numpy())
                tfs.append(f.values.to_numpy())
                size += len(terms[-1])
                if size >= SHARD:
                    yield shard_row(documents, terms, tfs, statistics)
                    documents, terms, tfs, size = [], [], [], 0
        if size:
            yield shard_row(documents, terms, tfs, statistics)

    return in_arrow(rows.where(F.size("terms") > 0).coalesce(tasks), INDEX, work)


def shards_of(batches):
    for b in batches:
        for row in zip(*b.columns, strict=True):
            x = [c.values.to_numpy(zero_copy_only=False) for c in row]
            yield Shard(*x)


def search(docs: DataFrame, items: DataFrame, top: int = 10, most_items: int = 20_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents of the highest scores above 0 for each row of items, equal scores by doc_id."""
    kind = items.schema["item_id"].dataType.simpleString()
    parts = -(-items.count() // most_items)
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in range(parts):
        asked = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        words = [sorted(set(terms_of(bytes(r["text"]) if r["text"] is not None else None))) for r in asked]
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        if not vocabulary:
            continue
        queries = [np.array([vocabulary[w] for w in ws], np.int64) for ws in words]

        def work(batches, queries=queries):
            best = [[] for _ in queries]
            for shard in shards_of(batches):
                for q, terms in enumerate(queries):
                    if len(terms):
                        best[q] = shard.search(terms, best[q], top)
            rows = [(q, None if missing else doc, -score) for q, found in enumerate(best) for score, missing, doc in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["q", "doc_id", "score"])

        found = in_arrow(index(docs, vocabulary), "q long, doc_id long, score long", work)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(asked)], f"q long, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))  # names: at most most_items rows
    return out
