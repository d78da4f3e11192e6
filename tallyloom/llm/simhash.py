"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and into 3-word shingles, repeats included; the XXH64 values of the shingles
vote for the 64 bits. Texts whose fingerprints differ in two bits or fewer are linked, and a component is named after its smallest doc_id.

Search, over the distinct fingerprints only: each is cut into two 32-bit segments. If two fingerprints differ in at most two bits, their low
segments are equal or their high segments differ in at most one bit. So one table holds the low segments, which are looked up as they are, and one
the high segments, which are looked up with all members of the Hamming ball of radius one. Of two values that differ in one bit, one has a 0
there, so only those bits are turned on. Every pair that a table entry brings together is verified by its whole distance.

Entries with more than `most` members could make quadratically many pairs. Their members go another exact way: each fingerprint is filed under
itself and its 64 neighbours. Two fingerprints are within two bits just when they share such a key, and no key can have over 65 members, so
linking each member to the smallest one of its key loses nothing and needs no pairs.

one_of_each() keeps one document of each group of near copies: texts with a five-word similarity of 0.8 or more. Each text (by its words in lower case) is filed under the fifth of its five-word shingles
that comes first in one order of all shingles, so that all pairs of similarity 0.8 or more share a key, whatever the order is. The order only decides how much company keys have: shingles go by how often the corpus has
their rarest word (counted in 1,048,576 buckets), then by hash, so what many texts share comes last. A text has as many keys as its length asks for, however large the corpus is; they are never stored, but worked out from
the texts and sent to the place of the key once. Texts that share a key with none stay; the others are compared by their shingles.

Texts stay or go in the order of their sizes, then of their least doc_ids: one stays if no similar one before it does. Those of crowded keys (over `most` early texts) go through rounds before: the first takes some 256 of them
by a hash, each next one eight times as many. The heads of a round are compared with each other and settled; then all other texts are compared with the heads that stay, and those that are similar to one go. So each dropped
text is similar to the one that stays for it, without chains, and of a group of k copies few pairs are ever listed: a group has few heads in an early round, and what is left of it in a late one is near to few others. Pairs are sought within the keys, in tiles where these are crowded. Only pairs that pass exact bounds (sizes, a
bitmap of 1,024 bits) are verified, by their texts, which are read again for it. No limit cuts the search short; in a crowd of texts that are near and yet unlike the comparisons, but not the rows, grow with its square.

Null and empty texts have fingerprint zero and are linked like any other. Rows with the same doc_id stay separate rows with their own
fingerprints. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, in_arrow, row_numbers, sized, text_bytes

SEED, OTHER_SEED = 42, 7
ROUNDS = 60


def voted(shingles: list[bytes], seed: int = SEED) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    import xxhash

    votes = np.array([xxhash.xxh64_intdigest(x, seed) for x in shingles], dtype=">u8")
    ones = np.unpackbits(votes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(votes)).tobytes(), "big")


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """All runs of so many words; the whole text if it has fewer, none if it has no words."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(size)], strict=False)))


def fingerprint(text: bytes | None, shingle: int = 3, distinct: bool = False) -> int:
    shingles = shingles_of((text or b"").lower().split(), shingle)
    return voted(list(set(shingles)) if distinct else shingles) if shingles else 0


def fingerprints(docs: DataFrame, more: list[str] = [], shingle: int = 3, distinct: bool = False) -> DataFrame:  # noqa: B006
    """doc_id, the columns of more, and fp, a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("binary").alias("_text"))
    schema = rows.select("doc_id", *more, F.lit(None).cast("long").alias("fp")).schema

    def work(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle, distinct) for x in b.column(len(more) + 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], ["doc_id", *more, "fp"])

    return in_arrow(rows, schema, work)


def stars(fps: DataFrame) -> DataFrame:
    """Edges a, b (a < b) within two bits, whose components are those of all pairs within two bits; each fingerprint is filed under the 65 keys of its ball."""
    one = F.lit(1).cast("long")
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i))))
    filed = fps.select("fp", F.explode(around).alias("key"))
    met = filed.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    return met.select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, 64)).alias("b")).distinct()


def links(fps: DataFrame, radius: int = 2, most: int = 64) -> DataFrame:
    """Edges a, b (a < b) between distinct fingerprints, column fp, whose components are those of all pairs within the radius; every edge is such a pair."""
    if radius != 2:
        raise ValueError("the segments are laid out for two bits")
    high = F.shiftrightunsigned("fp", 32)
    one = F.lit(1).cast("long")
    flips = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("shiftrightunsigned(fp, 32)").bitwiseAND(F.call_function("shiftleft", one, i)) == 0)
    entry = lambda key, segment, probe: F.struct(key.alias("key"), F.lit(segment).alias("segment"), F.lit(probe).alias("probe"))
    ball = F.transform(flips, lambda i: entry(high.bitwiseOR(F.call_function("shiftleft", one, i)), 1, True))
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    entries = fps.select("fp", F.explode(F.concat(F.array(entry(low, 0, False), entry(high, 1, False)), ball)).alias("e")).select("fp", "e.*")
    sizes = entries.groupBy("segment", "key").agg(F.count_if(~F.col("probe")).alias("held"), F.count("*").alias("n"))
    live = sizes.where((F.col("held") > 0) & (F.col("n") > 1)).select("segment", "key", (F.col("n") > most).alias("crowded"))
    met = durable(entries.join(live, ["segment", "key"]))
    quiet = met.where(~F.col("crowded")).groupBy("segment", "key").agg(F.collect_list(F.struct("fp", "probe")).alias("m"))
    left = quiet.select("m", F.explode("m").alias("x")).select(F.col("x.fp").alias("x"), F.col("x.probe").alias("p"), F.explode("m").alias("y"))
    pairs = left.where((F.col("x") != F.col("y.fp")) & ~F.col("y.probe") & (F.col("p") | (F.col("x") < F.col("y.fp"))))
    pairs = pairs.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y.fp"))) <= radius).select(F.least("x", "y.fp").alias("a"), F.greatest("x", "y.fp").alias("b"))
    crowd = met.where("crowded").select("fp").distinct()
    return pairs.unionByName(stars(crowd)).distinct()


def ball_keys(parts: int, column: str = "fp") -> list[Column]:
    """For each of so many segments of a fingerprint, the keys of the ball of radius one around it; keys tell the segments apart."""
    cuts, one = [64 * i // parts for i in range(parts + 1)], F.lit(1).cast("long")

    def keys(number: int, low: int, width: int) -> Column:
        own = F.shiftrightunsigned(column, low).bitwiseAND((1 << width) - 1) if parts > 1 else F.col(column)
        ball = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: own.bitwiseXOR(F.call_function("shiftleft", one, i)))
        return F.transform(F.concat(F.array(own), ball), lambda k: k * parts + number)

    return [keys(s, lo, hi - lo) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]


#: Rows of one key from which on the key counts as hot.
HOT = 1000


def by_hot_key(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows joined with few on key, which few has once with the number n of its rows; hot keys, at most one in HOT rows, are broadcast, so that no task gets one whole."""
    hot = few.where(F.col("n") > HOT).drop("n")
    if hot.isEmpty():
        return rows.join(few.drop("n"), key)
    hot = sized(hot)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(few.where(F.col("n") <= HOT).drop("n"), key))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches), by rounds of large and small stars until nothing moves; edges: a, b of one orderable type.

    Neighbours of a hub are handled by aggregates and joins, never gathered in a list, and those of a hot hub by broadcast of the hub's one row."""
    e = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    mark = None
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        large = by_hot_key(both, low, "a").where("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), "a", "b")
        small = small.toDF("m", "a", "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
        e = durable(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, most: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links (other fingerprints that the search linked this one to directly)."""
    own = durable(fingerprints(docs))
    classes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = durable(links(classes.select("fp"), most=most))
    roots = components(edges)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    heads = roots.select(F.col("root").alias("fp")).distinct().join(classes, "fp").select(F.col("fp").alias("root"), "fp", "least")
    ids = named.unionByName(heads).groupBy("root").agg(F.min("least").alias("component_id"))
    moved = named.unionByName(heads).select("fp", "root").distinct().join(ids, "root").select("fp", "component_id")
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    per_class = classes.join(moved, "fp", "left").join(degree, "fp", "left")
    per_class = per_class.select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return by_hot_key(own, durable(per_class), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def signatures(rows: DataFrame) -> DataFrame:
    """key, h (a hash of the words), f1 and f2 (fingerprints of the distinct two-word shingles by two seeds) of rows of key and text (binary)."""
    import xxhash

    def one(text: bytes | None) -> tuple[int, int, int]:
        words = (text or b"").lower().split()
        if not words:
            return 0, 0, 0
        pairs = list(set(shingles_of(words, 2)))
        return xxhash.xxh64_intdigest(b" ".join(words), SEED), voted(pairs), voted(pairs, OTHER_SEED)

    def work(batches):
        for b in batches:
            found = np.array([one(x) for x in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, k], pa.int64()) for k in range(3)]], ["key", "h", "f1", "f2"])

    schema = rows.select("key", *[F.lit(None).cast("long").alias(x) for x in ("h", "f1", "f2")]).schema
    return in_arrow(rows.select("key", "text"), schema, work)


class WordHashes(dict):
    """XXH64 of words; no word has 0."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh64_intdigest(word, SEED) if word else 0
        return found


#: Words whose hashes a task keeps.
KEPT_WORDS = 400_000
FACTOR, LAST_FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_in(texts: list[bytes | None], hashes: WordHashes, size: int = 1) -> tuple[np.ndarray, list[int]]:
    """The hashes of the texts' words, and how many each text has; 0 fills up what has fewer than so many words, but some."""
    if len(hashes) > KEPT_WORDS:
        hashes.clear()
    lists = [(t or b"").lower().split() for t in texts]
    lists = [x + [b""] * (size - len(x)) if 0 < len(x) < size else x for x in lists]
    return np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64), list(map(len, lists))


def shingle_hashes(texts: list[bytes | None], hashes: WordHashes, size: int = 5, order: np.ndarray | None = None) -> list[np.ndarray]:
    """Of each text the distinct hashes of the runs of so many words (all words, if it has fewer; none without words), in order; with an order of the words' buckets, by the least of the words', then by hash."""
    flat, sizes = words_in(texts, hashes, size)
    runs = range(max(0, len(flat) - size + 1))
    mixed = np.zeros(len(runs), np.uint64)
    for k in range(size):
        mixed = mixed * FACTOR + flat[k : k + len(runs)]
    mixed = (mixed ^ mixed >> np.uint64(32)) * LAST_FACTOR
    mixed ^= mixed >> np.uint64(29)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    spans = [slice(e - n, max(e - size + 1, 0)) if n else slice(0, 0) for e, n in zip(ends, sizes, strict=True)]
    if order is None:
        return [np.unique(mixed[x]) for x in spans]
    by_word = order[(flat & np.uint64(BUCKETS - 1)).view(np.int64)]
    least = reduce(np.minimum, [by_word[k : k + len(runs)] for k in range(size)])
    out = []
    for x in spans:
        found, at = np.unique(mixed[x], return_index=True)
        out.append(found[np.argsort(least[x][at], kind="stable")])
    return out


def text_hashes(texts: list[bytes | None]) -> np.ndarray:
    """Two hashes of each text's words."""
    import xxhash

    words = [b" ".join((t or b"").lower().split()) for t in texts]
    return np.array([[xxhash.xxh64_intdigest(x, seed) for seed in (SEED, OTHER_SEED)] for x in words], dtype=np.uint64).reshape(-1, 2).view(np.int64)


def bitmaps(found: list[np.ndarray], n: int) -> pa.Array:
    """Of each set n bits, each whether an odd number of its hashes falls on it."""
    return pa.array([np.packbits(np.bincount((x & np.uint64(n - 1)).view(np.int64), minlength=n).astype(np.uint8) & 1).view(np.int64) for x in found], pa.list_(pa.int64()))


def shingle_sets(texts: DataFrame, size: int = 5) -> DataFrame:
    """c, sh (hashes of the distinct shingles of so many words), bits and wide (256 and 1,024, each whether an odd number of them falls on it); of rows of c and text (binary)."""

    def work(batches):
        hashes = WordHashes()
        for b in batches:
            found = shingle_hashes(b.column(1).to_pylist(), hashes, size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), *[bitmaps(found, n) for n in (256, 1024)]], ["c", "sh", "bits", "wide"])

    return in_arrow(texts.select("c", "text"), "c long, sh array<bigint>, bits array<bigint>, wide array<bigint>", work)


def signs(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns named; h and h2 (hashes of the words), size (of the distinct five-word shingles), wide (1,024 bits, each whether an odd number of them falls on it); of rows with a column text (binary)."""
    rows = rows.select(*names, "text")
    schema = rows.select(*names, *[F.lit(None).cast(t).alias(x) for x, t in (("h", "long"), ("h2", "long"), ("size", "int"), ("wide", "array<bigint>"))]).schema

    def work(batches):
        hashes = WordHashes()
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            found, own = shingle_hashes(texts, hashes), text_hashes(texts)
            size = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own[:, 0]), pa.array(own[:, 1]), size, bitmaps(found, 1024)], [*names, "h", "h2", "size", "wide"])

    return in_arrow(rows, schema, work)


#: Buckets of words, slices in which their counts are summed, and words that a task holds before it counts them.
BUCKETS, SLICES, COUNTED = 1 << 20, 64, 1_000_000


def crowding(texts: DataFrame) -> np.ndarray:
    """By bucket (the last bits of a word's hash), how often the texts (column text, binary) have its words, as eight times the binary logarithm; a task tells up to 255 of a bucket, which is enough for an order."""
    names, width = ["slice", "counts"], BUCKETS // SLICES

    def count(batches):
        hashes, total, held = WordHashes(), np.zeros(BUCKETS, np.uint8), []

        def counted() -> np.ndarray:
            here = np.bincount((np.concatenate(held) & np.uint64(BUCKETS - 1)).view(np.int64), minlength=BUCKETS)
            return np.minimum(total + here, 255).astype(np.uint8)

        for b in batches:
            held.append(words_in(b.column(0).to_pylist(), hashes)[0])
            if sum(map(len, held)) >= COUNTED:
                total, held = counted(), []
        total = counted() if held else total
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.uint8).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([(8 * np.log2(1 + x)).astype(np.uint16).tobytes() for x in sums.values()], pa.binary())], names)

    parts = in_arrow(texts.select("text"), "slice int, counts binary", count).repartition(SLICES, "slice")
    out = np.zeros(BUCKETS, np.uint16)
    for r in in_arrow(parts, "slice int, counts binary", add).collect():  # SLICES rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint16)
    return out


def fronts(rows: DataFrame, order: np.ndarray, names: list[str], once: bool = False) -> DataFrame:
    """The columns named; h and h2 (hashes of the words), size (of the distinct five-word shingles), front (the first of them in the order: crowding of the rarest word, then hash), early (how many of the front are
    early); of rows with a column text (binary); once: without copies of what the task has just had.

    Of a pair with a similarity of 0.8 or more each has at least four fifths of its own shingles in common with the other, the smaller one eight ninths; if no shingle among the first n - ceil(4n / 5) + 1 of the one and the
    first n - ceil(8n / 9) + 1 of the other, in one order for all, were the same, fewer would be left."""
    rows = rows.select(*names, "text")
    schema = rows.select(*names, *[F.lit(None).cast(t).alias(x) for x, t in (("h", "long"), ("h2", "long"), ("size", "int"), ("early", "int"), ("front", "array<bigint>"))]).schema

    def work(batches):
        hashes, seen = WordHashes(), set()
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            own = text_hashes(texts)
            if once:
                new = []
                for i, x in enumerate(map(tuple, own.tolist())):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                b, texts, own = b.take(pa.array(new, pa.int64())), [texts[i] for i in new], own[new]
                if len(seen) > KEPT_WORDS:
                    seen.clear()
            found = shingle_hashes(texts, hashes, order=order)
            size = np.array([len(x) for x in found], dtype=np.int32)
            first = np.where(size > 0, size + 1 + -4 * size // 5, 0)
            front = [x[:k].view(np.int64) for x, k in zip(found, first.tolist(), strict=True)]
            early = np.where(size > 0, size + 1 + -8 * size // 9, 0)
            numbers = [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(size), pa.array(early.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *numbers, pa.array(front, pa.list_(pa.int64()))], [*names, "h", "h2", "size", "early", "front"])

    return in_arrow(rows, schema, work)


def bounded(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """The pairs (c, to) that can have a similarity of 0.8 or more by the sizes and bitmaps of the cards (c, size, wide): a bit in which they differ needs a shingle that only one has."""
    hubs = pairs.groupBy("to").agg(F.count("*").alias("n")).join(cards.select(F.col("c").alias("to"), F.col("size").alias("_m"), F.col("wide").alias("_b")), "to")
    met = by_hot_key(pairs.join(cards.select("c", F.col("size").alias("_n"), F.col("wide").alias("_a")), "c"), hubs, "to")
    apart = reduce(Column.__add__, [F.bit_count(F.col("_a")[i].bitwiseXOR(F.col("_b")[i])) for i in range(16)])
    return met.where((5 * F.least("_n", "_m") >= 4 * F.greatest("_n", "_m")) & (9 * apart <= F.col("_n") + F.col("_m"))).select("c", "to")


#: Texts that are compared with another one in one group.
SPREAD = 32


def verified(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (c, to) whose texts have a similarity of 0.8 or more; texts_of(frame of c) gives the texts (binary).

    Each text goes to the other one of its pairs; one that has many pairs goes to several groups instead, so that no task gets all of them."""
    n = pairs.count()
    hubs = pairs.groupBy("to").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("_parts"))
    each = pairs.join(hubs, "to").select("c", "to", F.pmod(F.xxhash64("c"), F.col("_parts")).cast("int").alias("part"))
    sends = durable(packed(each.unionByName(hubs.select(F.col("to").alias("c"), "to", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))), 2 * n))
    if sends.isEmpty():
        return sends.select("c", "to")

    def compare(group: pa.Table) -> pa.Table:
        c, to = group.column("c").to_pylist(), group.column("to")[0].as_py()
        found = shingle_hashes(group.column("text").to_pylist(), WordHashes())
        hub, like = found[c.index(to)], []
        for i, own in zip(c, found, strict=True):
            common = len(np.intersect1d(own, hub, assume_unique=True))
            if i != to and 5 * common >= 4 * (len(own) + len(hub) - common):
                like.append(i)
        return pa.table({"c": pa.array(like, pa.int64()), "to": pa.array([to] * len(like), pa.int64())})

    return texts_of(sends.select("c").distinct()).join(sized(sends), "c").groupBy("to", "part").applyInArrow(compare, "c long, to long")


#: Rows of narrow frames, of numbers and short bitmaps, that make up a part at least.
PACKED = 20_000


def packed(rows: DataFrame, n: int) -> DataFrame:
    """The rows, at most n, in no more parts than hold PACKED of them each: many tiny parts cost more files and tasks than they have rows."""
    return rows.coalesce(max(1, -(-n // PACKED)))


#: Leading bits of a 32-bit segment by which texts are dealt: all of a ball but so many keys lie in its centre's place.
PLACE = 12


def in_company(texts: DataFrame) -> DataFrame:
    """c of the texts (c, f1, f2) that share a key with another one, where each is filed under the balls of radius one of its four 32-bit segments.

    The keys of a ball that agree in their first bits travel as one row, and are written out where they have arrived: 52 rows a text are shuffled, not 132, once."""
    one, tail = F.lit(1).cast("long"), 32 - PLACE
    around = lambda x, bits: F.concat(F.array(x), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: x.bitwiseXOR(F.call_function("shiftleft", one, i))))
    parts = [F.shiftrightunsigned(f, low).bitwiseAND(0xFFFFFFFF) for f in ("f1", "f2") for low in (0, 32)]
    segments = texts.select("c", F.posexplode(F.array(*parts)).alias("segment", "x")).select("c", "segment", F.shiftrightunsigned("x", tail).alias("head"), F.col("x").bitwiseAND((1 << tail) - 1).alias("tail"))
    sent = segments.select("c", "segment", "tail", F.posexplode(around(F.col("head"), PLACE)).alias("flip", "place"))
    sent = sent.select((F.col("place") * 4 + F.col("segment")).alias("place"), (F.col("tail") * 2 + (F.col("flip") == 0).cast("long")).alias("x"), "c").repartition("place")
    own = F.shiftrightunsigned("x", 1)
    keys = sent.select("place", "c", F.explode(F.when(F.col("x") % 2 == 1, around(own, tail)).otherwise(F.array(own))).alias("key"))
    held = keys.withColumn("n", F.count("*").over(Window.partitionBy("place", "key")))
    return held.where("n > 1").select("c").distinct()


def filed_by_rare_shingles(sets: DataFrame) -> DataFrame:
    """key, c, size, held, early: each text (c, sh) under so many of its rarest shingles that two texts with a similarity of 0.8 or more share one of them, which is early for the one with fewer shingles (for both, if
    they have as many). size: of its shingles, held: of those that another text has, too.

    Of such a pair each has at least four fifths of its own shingles in common with the other, the smaller one eight ninths; if no shingle among the first n - ceil(4n / 5) + 1 of the one and the first
    n - ceil(8n / 9) + 1 of the other, in one order for all, were the same, fewer would be left."""
    each = sets.select("c", F.explode("sh").alias("s"))
    common = durable(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))  # a shingle of one text has its place in the order, but joins nothing
    counted = by_hot_key(each.withColumnRenamed("s", "key"), common.select(F.col("s").alias("key"), F.col("n"), F.col("n").alias("df")), "key")
    size = F.size("sh")
    alone = sets.select("c", size.alias("size"), (size - F.ceil(size * 4 / 5) + 1).alias("first"), (size - F.ceil(size * 8 / 9) + 1).alias("earliest"))
    listed = counted.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("g")).join(alone, "c").withColumn("held", F.size("g"))
    before = F.col("size") - F.col("held")  # the shingles of one text come first
    left = F.col("first") - before
    out = listed.where(left > 0).select("c", "size", "held", (F.col("earliest") - before).alias("_early"), F.posexplode(F.slice("g", 1, left.cast("int"))).alias("_at", "_g"))
    return out.select(F.col("_g.key").alias("key"), "c", "size", "held", (F.col("_at") < F.col("_early")).alias("early"))


def settled(edges: DataFrame) -> DataFrame:
    """c, kept of edges c, to (to < c): in the order of their numbers, a text stays if no neighbour before it does, else it goes for the first that stays. Each turn settles all that wait for no other."""
    gone, e = [], durable(edges)
    n = e.count()
    e = packed(e, n)
    while not e.isEmpty():
        waiting = e.select(F.col("c").alias("to")).distinct()
        found = durable(packed(e.join(waiting, "to", "left_anti").groupBy("c").agg(F.min("to").alias("kept")), n))
        done = found.select("c").unionByName(e.select(F.col("to").alias("c")).join(waiting.withColumnRenamed("to", "c"), "c", "left_anti")).distinct()
        gone.append(found)
        e = durable(packed(e.join(done, "c", "left_anti").join(done.withColumnRenamed("c", "to"), "to", "left_anti"), n))
    out = edges.select("c", F.col("to").alias("kept")).where("false")
    for found in gone:
        out = out.unionByName(found)
    return durable(packed(out, n))


#: Early and other members of a crowded key that are compared in one tile.
TILE_EARLY, TILE_ALL = 512, 8192
#: Least keys of a text by which a tile tells that an earlier key lists a pair.
SEEN = 64


def crowded_pairs(entries: DataFrame, crowded: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """c, to of the pairs of entries (key, c, size, held, bits, early) that may match, to being early and less, within crowded keys (key, k, n: their early and all members), tile by tile; only such pairs leave a tile.
    With partners, to is any of the entries and c one of the partners (k, n: how many a key has of these and of those).

    A pair that has several keys in common leaves by the least of them, and by a later one only if the SEEN least keys of the two texts don't show it."""
    between = partners is not None

    def met(rows: DataFrame) -> DataFrame:
        rows = by_hot_key(rows.select("key", "c", "size", "held", "bits"), crowded.withColumn("_n", F.col("n")), "key")
        return rows.join(rows.groupBy("c").agg(F.slice(F.sort_array(F.collect_list("key")), 1, SEEN).alias("seen")), "c")

    rows, columns = F.ceil(F.col("k") / TILE_EARLY).cast("int"), F.ceil(F.col("_n") / TILE_ALL).cast("int")
    own = lambda n: F.array(F.pmod(F.xxhash64("c"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_lead = met(entries if between else entries.where("early")).select("key", "c", "size", "held", "bits", "seen", F.lit(True).alias("lead"), F.explode(own(rows)).alias("i"), columns.alias("_m")).withColumn("j", F.explode(every(F.col("_m")))).drop("_m")
    as_any = met(partners if between else entries).select("key", "c", "size", "held", "bits", "seen", F.lit(False).alias("lead"), F.explode(every(rows)).alias("i"), columns.alias("_m")).withColumn("j", F.explode(own(F.col("_m")))).drop("_m")

    def compare(tile: pa.Table) -> pa.Table:
        key, c, size, held = (tile.column(x).to_numpy() for x in ("key", "c", "size", "held"))
        bits, lead = np.array(tile.column("bits").to_pylist(), dtype=np.int64).view(np.uint64), tile.column("lead").to_numpy(zero_copy_only=False)
        before = [[x for x in keys if x < here] for keys, here in zip(tile.column("seen").to_pylist(), key.tolist(), strict=True)]
        earlier = np.full((len(c), max(map(len, before), default=0)), key[0])  # no key before this one is this one
        for i, keys in enumerate(before):
            earlier[i, : len(keys)] = keys
        rest, out = np.flatnonzero(~lead), [np.zeros((2, 0), np.int64)]
        for i in np.flatnonzero(lead):
            at = rest if between else rest[c[rest] > c[i]]
            both = size[i] + size[at]
            enough = 9 * np.minimum(held[i], held[at]) >= 4 * both
            at, both = at[enough], both[enough]
            at = at[9 * np.bitwise_count(bits[i] ^ bits[at]).sum(axis=1, dtype=np.int64) <= both]
            if before[i]:
                at = at[~np.isin(earlier[at], before[i]).any(axis=1)]
            out.append(np.stack([c[at], np.full(len(at), c[i])]))
        found = np.concatenate(out, axis=1)
        return pa.table({"c": pa.array(found[0], pa.int64()), "to": pa.array(found[1], pa.int64())})

    return as_lead.unionByName(as_any).groupBy("key", "i", "j").applyInArrow(compare, "c long, to long")


def in_shared_fronts(filed: DataFrame) -> DataFrame:
    """key, c, early: the shingles of the fronts (filed: c of 63 bits, front, early; copies have one c) that another text's front has, too, and that are early for one of them, once each."""
    each = filed.select("c", F.col("early").alias("_k"), F.posexplode("front").alias("_at", "key")).select("key", (2 * F.col("c") + (F.col("_at") < F.col("_k")).cast("long")).alias("x"))
    key, c, early = Window.partitionBy("key"), F.shiftright("x", 1), F.col("x").bitwiseAND(1)
    met = each.withColumn("_first", F.min(c).over(key)).withColumn("_last", F.max(c).over(key)).withColumn("_led", F.max(early).over(key))
    return met.where("_first < _last and _led = 1").select("key", "x").distinct().select("key", c.alias("c"), (early == 1).alias("early"))


def tiled(entries: DataFrame, crowded: DataFrame, cards: DataFrame) -> DataFrame:
    """The entries of crowded keys as crowded_pairs() reads them."""
    return entries.join(sized(crowded.select("key")), "key", "left_semi").join(cards.select("c", F.col("wide").alias("bits")), "c").withColumn("held", F.col("size"))


def met_within(entries: DataFrame, cards: DataFrame, most: int) -> DataFrame:
    """c, to of the pairs of entries (key, c, size, early; c in order of size) that share a key that is early for to, the lesser one, and may match."""
    counts = durable(entries.groupBy("key").agg(F.count_if("early").alias("k"), F.count("*").alias("n")).where("k > 0 and n > 1"))
    crowded = counts.where(F.col("k") > most)
    led = entries.where("early").join(counts.where(F.col("k") <= most).select("key", "n"), "key").groupBy("key").agg(F.collect_list(F.struct("c", "size")).alias("g"), F.first("n").alias("n"))
    near = F.filter("g", lambda l: (l["c"] < F.col("c")) & (5 * l["size"] >= 4 * F.col("size")))
    pairs = by_hot_key(entries, durable(led), "key").select("c", F.explode(near).alias("_l")).select("c", F.col("_l.c").alias("to")).distinct()
    if crowded.isEmpty():
        return pairs
    return pairs.unionByName(crowded_pairs(tiled(entries, crowded, cards), crowded)).distinct()


def met_between(heads: DataFrame, entries: DataFrame, out: DataFrame, cards: DataFrame, most: int) -> DataFrame:
    """c, to of the pairs of one of the entries, c, but for those of out, and one of the heads, to (all: key, c, size, early), that share a key that is early for one of them and may match."""
    keys = durable(heads.groupBy("key").agg(F.count("*").alias("k")).transform(packed, heads.count()))
    met = durable(entries.join(sized(keys.select("key")), "key", "left_semi").join(sized(out), "c", "left_anti"))
    counts = durable(keys.join(met.groupBy("key").agg(F.count("*").alias("n")), "key"))
    crowded = counts.where(F.col("k") > most)
    led = heads.join(counts.where(F.col("k") <= most).select("key", "n"), "key").groupBy("key").agg(F.collect_list(F.struct("c", "size", "early")).alias("g"), F.first("n").alias("n"))
    near = F.filter("g", lambda l: (l["early"] | F.col("early")) & (5 * F.least(l["size"], F.col("size")) >= 4 * F.greatest(l["size"], F.col("size"))))
    pairs = by_hot_key(met, durable(led), "key").select("c", F.explode(near).alias("_l")).select("c", F.col("_l.c").alias("to")).distinct()
    if crowded.isEmpty():
        return pairs
    return pairs.unionByName(crowded_pairs(tiled(heads, crowded, cards), crowded, tiled(met, crowded, cards))).distinct()


#: Texts that the first round takes, and how many times as many each next one does.
FIRST, MORE = 256, 8


def resolved(entries: DataFrame, cards: DataFrame, texts_of: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """c, kept: for each text that goes, the similar one that stays; entries: key, c, size, early; cards: c (numbers in order of size), size, wide, once for each text. texts_of(frame of c) gives their texts (binary)."""
    similar = lambda pairs: durable(verified(durable(bounded(durable(pairs), cards)), texts_of))
    crowded = entries.groupBy("key").agg(F.count_if("early").alias("k")).where(F.col("k") > most).select("key")
    crowd = durable(entries.join(sized(durable(crowded)), "key", "left_semi").select("c").distinct())
    n, heads, gone, out = crowd.count(), FIRST, [], crowd.where("false")  # out: heads so far, and what has gone
    crowd = packed(crowd, n)
    while 2 * heads < n:
        chosen = durable(crowd.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < (heads << 30) // n).join(sized(out), "c", "left_anti"))
        own = durable(packed(entries.join(sized(chosen), "c", "left_semi"), n))
        gone.append(settled(similar(met_within(own, cards, most))))
        out = durable(packed(out.unionByName(chosen), n))
        stay = durable(packed(own.join(sized(gone[-1].select("c")), "c", "left_anti"), n))
        found = similar(met_between(stay, entries, out, cards, most))
        gone.append(durable(packed(found.groupBy("c").agg(F.min("to").alias("kept")), n)))
        out = durable(packed(out.unionByName(gone[-1].select("c")), n))  # the heads have met all others; what is similar to one that stays has gone
        heads *= MORE
    rest = durable(entries.join(sized(out), "c", "left_anti"))
    return reduce(DataFrame.unionByName, [*gone, settled(similar(met_within(rest, cards, most)))])


def stand_ins(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], most: int = 32) -> DataFrame:
    """c, kept: for each text that goes, the similar one that stays; classes: c. texts_of(frame of c) gives their texts (binary)."""
    texts = durable(texts_of(classes.select("c")))
    entries = durable(in_shared_fronts(fronts(texts, crowding(texts), ["c"])))
    cards = durable(row_numbers(signs(texts, ["c"]).select(F.col("c").alias("own"), "size", "wide"), ["size", "own"], "c"))
    named = lambda c, own: cards.select(F.col("c").alias(c), F.col("own").alias(own))
    entries = durable(entries.withColumnRenamed("c", "own").join(cards.select("own", "c", "size"), "own").drop("own"))

    def texts_here(few: DataFrame) -> DataFrame:
        found = texts_of(few.join(named("c", "own"), "c").select(F.col("own").alias("c")))
        return found.withColumnRenamed("c", "own").join(named("c", "own"), "own").select("c", "text")

    gone = resolved(entries, cards, texts_here, most)
    return gone.join(named("c", "_own"), "c").join(named("kept", "_kept"), "kept").select(F.col("_own").alias("c"), F.col("_kept").alias("kept"))


def one_of_each(docs: DataFrame, most: int = 32) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one row of each group of near copies does: of equal texts the first by doc_id (nulls last), size and hash. Repeated rows become one."""
    row = {"_none": F.col("doc_id").isNull(), "_id": F.col("doc_id").cast("long"), "_size": text_bytes(), "_tie": F.xxhash64("text")}
    key = F.struct(*[v.alias(k) for k, v in row.items()])
    texts = docs.select(key.alias("key"), F.col("text").cast("binary").alias("text"))
    own = durable(signs(texts, ["key"]))
    once = durable(own.groupBy("h", "h2", "key").agg(F.count("*").alias("n")))
    classes = durable(once.groupBy("h", "h2").agg(F.min("key").alias("least"), F.max("n").alias("copies")))
    repeated = not classes.where("copies > 1").isEmpty()
    # copies are filed under one number; that two other texts have the same one, too, costs a comparison
    number = F.shiftright("h", 1)
    entries = durable(in_shared_fronts(fronts(texts, crowding(texts), [], once=True).select(number.alias("c"), "early", "front")))
    shared = classes.withColumn("_c", number).join(sized(durable(entries.select(F.col("c").alias("_c")).distinct())), "_c", "left_semi").select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), F.col("least").alias("key"))
    cards = own.join(sized(durable(shared)), "key").where((F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2"))).select("key", "h", "h2", "size", "wide")  # repeated rows have the same
    cards = durable(row_numbers(cards.dropDuplicates(["key", "h", "h2"]) if repeated else cards, ["size", "key", "h", "h2"], "c"))
    entries = durable(entries.withColumnRenamed("c", "_c").join(sized(cards.select(number.alias("_c"), "c", "size")), "_c").drop("_c"))

    def texts_of(few: DataFrame) -> DataFrame:
        wanted = durable(few.join(cards, "c").select("c", F.col("key").alias("_key")))
        found = docs.select(key.alias("_key"), F.col("text").cast("binary").alias("text")).join(sized(wanted), "_key").select("c", "text")
        return found.groupBy("c").agg(F.first("text").alias("text")) if repeated else found

    gone = resolved(entries, cards, texts_of, most).join(cards, "c").select("key")
    stays = classes.select(F.col("least").alias("key")).join(gone, "key", "left_anti")
    lost = once.select("key").join(stays, "key", "left_anti").distinct()
    rows = docs.dropDuplicates(["doc_id", "text"]) if repeated else docs
    name = fresh(docs.columns, "_lost")
    return rows.join(sized(durable(lost.select(F.col("key").alias(name)))), key == F.col(name), "left_anti")
