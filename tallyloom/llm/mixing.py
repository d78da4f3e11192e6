"""Mixing of sources to target weights by Pfair scheduling, in DataFrame operations only.

The texts of a source, in order of doc_id, are laid end to end and cut into blocks of `block_bytes`; a document belongs to the block in which it starts (its
size: UTF-8 bytes plus 1). A source's target weight is its bytes to the power `alpha` (or the given weight), as a `share` of `slots` slots (16 times the number of sources if
that is more), to the nearest slot, one at least; the sum of the shares is the period. Block i (from 1) of a source with share q of period P is released at slot
floor((i-1)P/q) and due by slot ceil(iP/q); in each slot, of the blocks that are released the one that is due earliest is taken, the first source by name among equals. In
any prefix of the schedule, a source has less than one block more or less than its share asks for, and a share differs from its target by half a slot of the period (one for
sources below half a slot). The schedule repeats with the period, so it is worked out for one period and joined to the blocks: the table has one row per slot of a period,
whatever the size of the data.

`in_mix` is true up to the slot by which a source is a whole block behind its target weight, for lack of blocks: so far the mix meets its weights, and a source that runs out
within its last block doesn't end it. The rest, of over-represented sources, keeps its rows and slots.

within_weights() says which rows a mix keeps, by the same schedule: those whose block has a slot before its end, and the one block
of a source that is released but not yet due then (a source below a slot of the period has its first block due at the period's end). A source that has run out leaves its slots empty and the others go on by their shares, as long as those
that are gone have `spare` of all weights at most; the source that would exceed this ends the mix, as soon as it is a whole block behind its weight. So small sources stay whole and cost no other source anything:
10 GB and 600 KB beside them all stay, and so do the texts of a single source.

Null sources form a source of their own, named ''. Rows of one doc_id are ordered by size and text. Empty texts have size 1. An empty table gives no rows; columns of other
names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, running_totals, sized, text_bytes


SLOTS, CHUNK = 16384, 128


def shares(totals: DataFrame, weights: dict[str, float] | None, alpha: float, slots: int) -> DataFrame:
    """source, bytes, target (part of all weights), share; totals: a row per source."""
    w = F.pow(F.col("bytes").cast("double"), F.lit(alpha))
    if weights is not None:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)).cast("double")
    everything = Window.partitionBy(F.lit(1))
    whole = F.round(F.lit(float(slots)) * F.col("w") / F.sum("w").over(everything), 6)
    out = totals.withColumn("w", w).withColumns({"share": F.greatest(F.lit(1), F.floor(whole + 0.5)).cast("long"), "target": F.try_divide("w", F.sum("w").over(everything))})
    return out.select("source", "bytes", "target", "share")


def one_period(share: DataFrame) -> DataFrame:
    """source, share, period, turn (from 0), release, deadline, slot: earliest deadline first over the slots of one period."""
    one = share.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s"), F.sum("share").alias("p")).where("p is not null")
    # state: done[k] blocks of source k so far, and the source taken in each slot; slots are worked out CHUNK at a time, so that no long array grows by single slots
    pick = f"""
      aggregate(sequence(0L, (p - 1) div {CHUNK}),
        named_struct('done', transform(s, x -> 0L), 'taken', cast(array() as array<int>)),
        (whole, c) -> aggregate(sequence(c * {CHUNK}L, least(p, (c + 1) * {CHUNK}L) - 1),
          named_struct('done', whole.done, 'taken', cast(array() as array<int>)),
          (a, t) -> aggregate(
              array(array_min(transform(
                filter(sequence(0, size(s) - 1), k -> a.done[k] < s[k].share and (a.done[k] * p) div s[k].share <= t),
                k -> named_struct('due', ((a.done[k] + 1) * p + s[k].share - 1) div s[k].share, 'k', k))).k),
              a, (b, k) -> named_struct('done', transform(b.done, (n, j) -> if(j = k, n + 1, n)), 'taken', concat(b.taken, array(k)))),
          part -> named_struct('done', part.done, 'taken', concat(whole.taken, part.taken))),
        a -> a.taken)"""
    taken = one.select("s", "p", F.posexplode(F.expr(pick)).alias("slot", "k")).select(F.expr("s[k].source").alias("source"), F.expr("s[k].share").alias("share"), F.col("p").alias("period"), F.col("slot").cast("long").alias("slot"))
    turn = (F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1).cast("long")
    return taken.withColumn("turn", turn).withColumn("release", F.expr("turn * period div share")).withColumn("deadline", F.expr("((turn + 1) * period + share - 1) div share"))


def scheduled(docs: DataFrame, weights: dict[str, float] | None, alpha: float, block_bytes: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, tie, block, slot, release, deadline for each row of docs; and source, bytes, target, share."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (text_bytes() + 1).alias("size"), F.xxhash64("text").alias("tie"))
    placed = durable(running_totals(rows, ["source"], ["doc_id", "size", "tie"], {"before": "size"}).withColumn("block", F.expr(f"before div {block_bytes}")))
    totals = placed.groupBy("source").agg(F.sum("size").alias("bytes"))
    totals = durable(totals)
    share = durable(shares(totals, weights, alpha, max(slots, 16 * totals.count())))
    pattern = durable(one_period(share))  # a row for each slot, and at most one more for each source
    per_source = F.broadcast(pattern.select("source", "share", "period").distinct())
    timed = placed.join(per_source, "source").withColumn("turn", F.expr("block % share")).withColumn("round", F.expr("block div share"))
    timed = timed.join(F.broadcast(pattern.select("source", "turn", F.col("slot").alias("at"), F.col("release").alias("r"), F.col("deadline").alias("d"))), ["source", "turn"])
    shift = F.col("round") * F.col("period")
    return timed.select("doc_id", "source", "size", "block", (shift + F.col("at")).alias("slot"), (shift + F.col("r")).alias("release"), (shift + F.col("d")).alias("deadline"), "tie"), share


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.9, block_bytes: int = 65536, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, block, slot, release, deadline, in_mix, for each row of docs."""
    out, share = scheduled(docs, weights, alpha, block_bytes, slots)
    ends = share.where("target > 0").select((F.expr(f"(bytes + {block_bytes} - 1) div {block_bytes} + 1") / F.col("target")).alias("end"))
    end = ends.agg(F.round(F.min("end"), 3)).first()[0]
    return out.withColumn("in_mix", F.col("slot") < F.lit(end))


def within_weights(docs: DataFrame, alpha: float = 0.9, block_bytes: int = 65536, spare: float = 0.05, slots: int = SLOTS) -> DataFrame:
    """The rows of docs, with all their columns, whose blocks the schedule has taken when it ends, or whose window is open then: of each source the first in order of doc_id, size and text. Equal rows share their fate."""
    source, key = F.coalesce("source", F.lit("")), ("doc_id", (text_bytes() + 1).alias("size"), F.xxhash64("text").alias("tie"))
    out, share = scheduled(docs, None, alpha, block_bytes, slots)
    # of each source the slot by which it is a whole block behind its target; those that run out first leave together at most `spare` of all targets
    ends = share.withColumns({"end": (F.col("bytes") + block_bytes) / F.lit(block_bytes) / F.col("target"), "part": F.ceil(F.col("target") * 10**15)})
    ends = running_totals(ends.select("source", "part", "end"), [], ["end", "source"], {"gone": "part"})
    end = ends.where(F.col("gone") + F.col("part") > F.lit(int(spare * 10**15))).agg(F.min("end")).first()[0]
    if end is None:
        return docs
    of, latest = fresh(docs.columns, "_of"), fresh(docs.columns, "_last")
    last = durable(out.where(F.col("release") < F.lit(end)).groupBy("source").agg(F.max(F.struct("doc_id", "size", "tie")).alias(latest)).withColumnRenamed("source", of))
    return docs.join(sized(last), source == F.col(of)).where(F.struct(*key) <= F.col(latest)).drop(of, latest)
