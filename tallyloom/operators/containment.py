"""Which texts contain which patterns, by an inverted index of q-grams: an equi-join on one gram of each pattern, then a check of the whole pattern.

Grams are runs of bytes of the UTF-8 form. A pattern of less than 8 bytes is its own gram, so that the join alone decides. A longer one has grams of 8 bytes: the rarest among the texts is its key (a pattern with a gram that no
text has matches nothing), and what the join brings together is the texts that hold it; then the whole pattern is checked. So there is no limit on the number of patterns or texts and no nested loop.
Grams are numbers of 64 bits, worked out for all places of many texts at a time; a filter of fixed size keeps back most of those that are no pattern's, the join the rest.

Null texts and patterns match nothing. The empty pattern is in every text. Case matters; repeated texts and patterns are one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import durable, sized

#: Bytes of the longest grams.
LONGEST = 8
#: Bits of the number of a place in the filter, and bytes of texts whose grams are worked out together.
BITS, TOGETHER = 22, 4_000_000


def codes(flat: np.ndarray, n: int) -> np.ndarray:
    """The runs of n bytes, one from each place, as numbers."""
    padded = np.append(flat, np.zeros(8, np.uint8))
    return (np.ndarray((max(0, len(flat) - n + 1),), "<u8", padded, strides=(1,)) & np.uint64(2 ** (8 * n) - 1)).view(np.int64)


def places(code: np.ndarray) -> np.ndarray:
    """Of each number, its bit in the filter."""
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def filed(texts: DataFrame, used: list[int], only: dict[int, np.ndarray] | None = None) -> DataFrame:
    """text (null texts have none) and grams: its distinct grams of the lengths used, as n and gram, if there are any; of those outside the filters, some are left out."""
    schema = "text string, grams array<struct<n int, gram bigint>>"

    def of_one(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, known: dict[int, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        code = codes(flat, n)
        at = np.arange(len(code)) if known is None else np.flatnonzero(known[n][places(code)])
        row = np.searchsorted(starts, at, side="right") - 1
        inside = at + n <= ends[row]
        pairs = np.empty((int(inside.sum()), 2), np.int64)
        pairs[:, 0], pairs[:, 1] = row[inside], code[at[inside]]
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        return pairs[new, 0], pairs[new, 1]

    def work(batches):
        known = None if only is None else {n: np.unpackbits(np.frombuffer(only[n], np.uint8)).view(bool) if n in only else np.zeros(1 << BITS, bool) for n in used}
        for b in batches:
            whole, last = b.column(0).drop_null(), 0
            raw = whole.cast(pa.large_binary()).to_pylist()
            while last < len(raw):
                first, size = last, 0
                while last < len(raw) and (last == first or size + len(raw[last]) <= TOGETHER):
                    size, last = size + len(raw[last]), last + 1
                some = raw[first:last]
                ends = np.cumsum([len(x) for x in some])
                starts = ends - [len(x) for x in some]
                flat = np.frombuffer(b"".join(some), np.uint8)
                found = [of_one(flat, starts, ends, n, known) for n in used]
                row, gram = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                kind = np.repeat(np.array(used, np.int32), [len(f[0]) for f in found])
                order = np.argsort(row, kind="stable")
                count = np.bincount(row, minlength=len(some))
                held = np.flatnonzero(count)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[held])), pa.int32()), pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(gram[order])], ["n", "gram"]))
                yield pa.RecordBatch.from_arrays([whole.take(pa.array(first + held)), lists], ["text", "grams"])

    return texts.select("text").mapInArrow(work, schema)


def filters(keys: DataFrame) -> dict[int, bytes]:
    """Of the keys (n, gram), for each n the bits of the filter as bytes: of a fixed size, however many keys there are."""

    def work(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            n, gram = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(n).tolist():
                bits.setdefault(k, np.zeros(1 << BITS, bool))[places(gram[n == k])] = True
        for k, own in bits.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at)], ["n", "at"])

    at = keys.select("n", "gram").mapInArrow(work, "n int, at bigint").distinct().toArrow()
    n, at = at.column("n").to_numpy(), at.column("at").to_numpy()
    out = {}
    for k in np.unique(n).tolist():
        own = np.zeros(1 << BITS, bool)
        own[at[n == k]] = True
        out[k] = np.packbits(own).tobytes()
    return out


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text, pattern: the pairs of texts (column text) and patterns (column pattern) that occur, each once."""
    rows = texts.select("text").where("text is not null")
    texts = rows.distinct()
    patterns = durable(patterns.select("pattern").where("pattern is not null").distinct().withColumn("n", F.least(F.octet_length("pattern"), F.lit(LONGEST))))
    used = sorted(r["n"] for r in patterns.select("n").distinct().collect())  # nine at most
    met = [texts.select("text", F.lit("").alias("pattern")).where(F.lit(0 in used))]
    if lengths := [n for n in used if 0 < n < LONGEST]:  # such a pattern is its own gram
        short = durable(keyed(patterns.where(F.col("n").isin(lengths)), lengths))
        met.append(found_in(texts, lengths, short).select("text", "pattern"))
    if LONGEST in used:
        wanted = durable(keyed(patterns.where(F.col("n") == LONGEST), [LONGEST]))
        keys = wanted.select("n", "gram").distinct()
        # counted over all rows, so that no text moves: any gram that is there at all will do as a key, a rare one is cheaper
        counts = found_in(rows, [LONGEST], keys).groupBy("n", "gram").agg(F.count("*").alias("held"))
        rarest = wanted.join(counts, ["n", "gram"], "left").groupBy("pattern", "n").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("key"))
        chosen = durable(rarest.where("key.held > 0").select("pattern", "n", F.col("key.gram").alias("gram")))
        met.append(found_in(texts, [LONGEST], chosen).where(F.col("text").contains(F.col("pattern"))).select("text", "pattern"))
    return functools.reduce(DataFrame.unionByName, met[1:] if 0 not in used and len(met) > 1 else met)


def keyed(patterns: DataFrame, lengths: list[int]) -> DataFrame:
    """pattern, n, gram: the grams of each pattern that are of its own n."""
    each = filed(patterns.select(F.col("pattern").alias("text")), lengths).select(F.col("text").alias("pattern"), F.explode("grams").alias("g")).select("pattern", "g.n", "g.gram")
    return each.where(F.col("n") == F.least(F.octet_length("pattern"), F.lit(LONGEST)))


def found_in(texts: DataFrame, lengths: list[int], keys: DataFrame) -> DataFrame:
    """text joined to the keys by n and gram, once for each key that it holds."""
    each = filed(texts, lengths, filters(keys)).select("text", F.explode("grams").alias("g")).select("text", "g.n", "g.gram")
    return each.join(sized(keys), ["n", "gram"])


def without(rows: DataFrame, column: Column, patterns: DataFrame) -> DataFrame:
    """The rows whose column contains none of the patterns (column pattern); rows with a null stay."""
    marked = rows.withColumn("_text", column)
    hit = contained(marked.select(F.col("_text").alias("text")), patterns).select(F.col("text").alias("_hit")).distinct()
    return marked.join(hit, F.col("_text") == F.col("_hit"), "left_anti").drop("_text")


def neither_way(rows: DataFrame, column: Column, patterns: DataFrame) -> DataFrame:
    """The rows whose column neither contains a pattern nor is contained in one."""
    marked = rows.withColumn("_text", column)
    own = marked.select(F.col("_text").alias("text"))
    inner = contained(own, patterns).select(F.col("text").alias("_hit"))
    outer = contained(patterns.select(F.col("pattern").alias("text")), own.select(F.col("text").alias("pattern"))).select(F.col("pattern").alias("_hit"))
    return marked.join(inner.unionByName(outer).distinct(), F.col("_text") == F.col("_hit"), "left_anti").drop("_text")
