"""How far sources of a language differ in their words: all pairs of sources, by two-dimensional group-block tiling.

Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z in lower case. A language keeps the terms that at least `least` of its documents hold. With V kept terms, count occurrences of
one in a group (lang, source) and N the group's occurrences of all of them, its share is p = 1 + floor(1000000000 (count + 5) / (N + 5V)); a language has shares of its own. Two groups differ by the
sum of |p - q| over all kept terms; a term marks a group by p - q against its language, where that is above 0. All arithmetic is on integers, where needed of 38 digits.

Terms are counted per task and group, then added up by shuffle: the counts of a group are never in one task. Kept terms are numbered in each language and cut into chunks of `chunk`; the shares of a
group in a chunk are packed into one row (positions and shares of those that occur; the others have the group's least share). The groups of a language are numbered and cut into blocks of `block`. Every pair of
blocks is a tile; a packed row goes to each tile that its block is part of. A task goes through the chunks of a tile one after another and holds two blocks of one chunk and the tile's sums: a bound that depends neither on the
number of sources nor on that of terms.

Null text, lang and source are empty ones. Each row is a document; repeated rows count repeatedly. A group without terms has shares of none; a language without kept terms has differences of 0. A group that is
alone in its language has no pairs. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_arrow, running_totals, sized

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE, PRIOR = 1_000_000_000, 5
#: Counts that a task holds before it passes them on.
HELD = 400_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""

    def batch(held: dict):
        rows = [(*group, term, n, docs) for group, (total, inside) in held.items() for (term, n), docs in zip(total.items(), map(inside.__getitem__, total), strict=True)]
        lang, source, term, n, d = zip(*rows, strict=True)
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), text(term), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def work(batches):
        held, size = {}, 0
        for b in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = Counter(text.translate(FOLD).split())
                if not own:
                    continue
                total, inside = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(total)
                total.update(own)
                inside.update(own.keys())
                size += len(total) - before
                if size >= HELD:
                    yield batch(held)
                    held, size = {}, 0
        if size:
            yield batch(held)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    found = in_arrow(rows, "lang string, source string, term string, n long, docs long", work)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept)), in whole numbers of 38 digits; kept must be above 0."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = (wide(count) + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + PRIOR * wide(kept)
    return F.call_function("div", above, below) + 1


def add_differences(sums: dict, groups: list[int], rows: list[np.ndarray], across: int) -> None:
    """Adds up what the groups of a tile differ by in one chunk: of the first `across` groups each with all the others, or of all groups each with those behind it if that is 0."""
    matrix = np.stack(rows)
    for k in range(across or len(groups)):
        rest = across or k + 1
        for g, v in zip(groups[rest:], np.abs(matrix[rest:] - matrix[k]).sum(axis=1).tolist(), strict=True):
            sums[groups[k], g] = sums.get((groups[k], g), 0) + v


def tiles(packed: DataFrame, block: int) -> DataFrame:
    """lang, a, b (numbers of groups, a < b), value; packed: lang, group, blocks (of the language), chunk, width, least, at, p."""
    own = F.floor(F.col("group") / block).cast("long")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = packed.select("lang", "group", "chunk", "width", "least", "at", "p", F.explode(others).alias("tile")).select("lang", "tile.i", "tile.j", "chunk", "group", "width", "least", "at", "p")
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "lang", "i", "j").sortWithinPartitions("lang", "i", "j", "chunk", "group")

    def work(batches):
        tile, chunk, sums, groups, rows = None, None, {}, [], []

        def finish_chunk():
            if groups:
                across = 0 if tile[1] == tile[2] else sum(g // block == tile[1] for g in groups)
                add_differences(sums, groups, rows, across)
                groups.clear()
                rows.clear()

        def result():
            pairs = list(sums.items())
            columns = [pa.array([tile[0]] * len(pairs), pa.string()), *[pa.array([x[0][k] for x in pairs], pa.int64()) for k in (0, 1)], pa.array([x[1] for x in pairs], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

        for b in batches:
            lang, i, j, part, group, width, least = (b.column(k).to_pylist() for k in range(7))
            for r in range(len(lang)):
                here = (lang[r], i[r], j[r])
                if here != tile or part[r] != chunk:
                    finish_chunk()
                if here != tile:
                    if sums:
                        yield result()
                    sums = {}
                tile, chunk = here, part[r]
                row = np.full(width[r], least[r], np.int64)
                row[b.column(7)[r].values.to_numpy()] = b.column(8)[r].values.to_numpy()
                groups.append(group[r])
                rows.append(row)
        finish_chunk()
        if sums:
            yield result()

    return in_arrow(dealt, "lang string, a long, b long, value long", work)


def divergence(docs: DataFrame, least: int = 30, top: int = 50, block: int = 32, chunk: int = 32_768) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: for each group all other sources of its language by falling difference, and the `top` terms that mark it."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = durable(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "n")
    kept = durable(running_totals(kept.withColumn("_one", F.lit(1)), ["lang"], ["term"], {"number": "_one"}).drop("_one"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct()
    groups = running_totals(groups.withColumn("_one", F.lit(1)), ["lang"], ["source"], {"group": "_one"}).drop("_one")
    used = durable(counts.join(kept.withColumnRenamed("n", "lang_n"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "number"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg((F.floor((F.count("*") - 1) / block) + 1).cast("long").alias("blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
    groups = durable(groups.withColumns({"total": F.coalesce("total", F.lit(0)), "kept": F.coalesce("kept", F.lit(0))}))
    known = groups.select("lang", "source", "group", "total", "kept", "lang_total")
    shares = used.join(sized(known), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    marks = shares.withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = marks.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)

    placed = shares.groupBy("lang", "group", F.floor(F.col("number") / chunk).cast("long").alias("chunk")).agg(F.collect_list(F.struct((F.col("number") % chunk).cast("int").alias("at"), "p")).alias("x"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("kept") - 1, F.lit(0)) / chunk).cast("long"))
    none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0).alias("least")
    width = F.least(F.lit(chunk), F.col("kept") - F.col("chunk") * chunk).cast("int").alias("width")
    every = groups.select("lang", "group", "blocks", "kept", none, F.explode(chunks).alias("chunk")).join(placed, ["lang", "group", "chunk"], "left")
    x = F.coalesce("x", F.array().cast("array<struct<at:int,p:bigint>>"))
    packed = every.select("lang", "group", "blocks", "chunk", width, "least", F.transform(x, lambda e: e.at).alias("at"), F.transform(x, lambda e: e.p).alias("p"))
    found = durable(tiles(packed, block))
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda number, column: sized(groups.select("lang", F.col("group").alias(number), F.col("source").alias(column)))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    pairs = running_totals(pairs.withColumn("_one", F.lit(1)), ["lang", "source"], [F.desc("value"), F.col("item")], {"rank": "_one"}).withColumn("rank", F.col("rank") + 1)
    out = [part.select("lang", "source", F.lit(label).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for label, part in (("pair", pairs), ("term", marks))]
    return out[0].unionByName(out[1])
