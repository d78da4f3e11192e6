"""Sharding by a k-d tree: each node is split at a weighted median along its widest dimension, until leaves reach the target bytes.

The law is `bytes`: a node that is to hold n shards is cut where the bytes before it are nearest to floor(n/2)/n of its own, so sizes differ by about one text.
Dimensions (integers): n_chars, a hash of the lang, a hash of the source and the doc_id, each scaled by its range over the whole table; the widest one of a node is
the one with the largest scaled range. Rows that tie on that dimension are told apart by the doc_id, then by a row number, so neither a hot value nor a shared doc_id unbalances.

The median is found by refinement: bytes are summed in `bins` bins between the bounds that are left, for all nodes of a level at once, and the bin
with the median is refined until it holds one value. Only the sums, `bins` per node, come to the driver.

Size is the UTF-8 bytes of the text (null: none) plus 1. Slots are gapless in each shard, in order of doc_id. Rows of one doc_id stay separate rows. An empty table gives no rows. A null doc_id or metadata value counts as the least value. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, running_totals, text_bytes

LEAST = -(2**62)
DIMENSIONS = ("d_chars", "d_lang", "d_source", "d_doc")


def points(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None)
    code = lambda c: F.coalesce(F.crc32(value(c).cast("string").cast("binary")), F.lit(-1)).cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (text_bytes() + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.char_length(text).cast("long").alias("d_chars"), code("lang").alias("d_lang"), code("source").alias("d_source"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("d_doc"))


def by_node(values: dict[int, object], kind: str):
    """values[node] as a column; nodes of a level are at most as many as shards."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("node")).cast(kind)


def cut(rows: DataFrame, column, goals: dict[int, int], bounds: dict[int, tuple[int, int]], bins: int) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """For each node the least value up to which the bytes reach the goal, the bytes of the rows below that value, and of those at it (if searched for)."""
    low, high, below, size = {k: v[0] for k, v in bounds.items()}, {k: v[1] for k, v in bounds.items()}, dict.fromkeys(bounds, 0), {}
    while any(low[k] < high[k] for k in low):
        width = {k: (high[k] - low[k]) // bins + 1 for k in low}
        inside = rows.withColumn("_v", column).where((F.col("_v") >= by_node(low, "long")) & (F.col("_v") <= by_node(high, "long")))
        found = inside.groupBy("node", F.floor((F.col("_v") - by_node(low, "long")) / by_node(width, "long")).cast("long").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        for k in low:
            mine = sorted((r["bin"], r["bytes"]) for r in found if r["node"] == k)
            for b, n in mine:
                last, size[k] = b, n
                if below[k] + n >= goals[k]:
                    break
                below[k] += n
            else:  # the goal lies beyond all rows: the last bin has it
                below[k] -= n
            low[k], high[k] = low[k] + last * width[k], min(high[k], low[k] + (last + 1) * width[k] - 1)
    return low, below, size


def kd_shards(docs: DataFrame, shards: int = 8, bins: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row."""
    # what tells rows of one doc_id apart is fixed by the checkpoint
    rows = durable(points(docs).withColumn("node", F.lit(0)).withColumn("d_row", F.shiftrightunsigned(F.xxhash64("text_crc32", F.monotonically_increasing_id()), 2)))
    whole = rows.agg(*[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    span = {c: max(1, (whole[f"hi_{c}"] or 0) - (whole[f"lo_{c}"] or 0)) for c in DIMENSIONS}
    first, count = {0: 0}, {0: shards}  # of each node: its first shard and how many it is to hold
    while any(n > 1 for n in count.values()) and whole["lo_d_doc"] is not None:
        split = [k for k, n in count.items() if n > 1]
        stats = {r["node"]: r for r in rows.where(F.col("node").isin(split)).groupBy("node").agg(F.sum("size").alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        widest = {k: max(DIMENSIONS, key=lambda c: ((r[f"hi_{c}"] - r[f"lo_{c}"]) / span[c], -DIMENSIONS.index(c))) for k, r in stats.items()}
        live = rows.where(F.col("node").isin(list(stats)))
        axis = F.coalesce(*[F.when(F.col("node").isin([k for k in widest if widest[k] == c] or [-1]), F.col(c)) for c in DIMENSIONS])
        goals = {k: r["bytes"] * (count[k] // 2) // count[k] for k, r in stats.items()}
        at, below, _ = cut(live, axis, goals, {k: (r[f"lo_{widest[k]}"], r[f"hi_{widest[k]}"]) for k, r in stats.items()}, bins)
        tied = live.where(axis == by_node(at, "long"))
        ends = {r["node"]: (r["lo"], r["hi"]) for r in tied.groupBy("node").agg(F.min("d_doc").alias("lo"), F.max("d_doc").alias("hi")).collect()}
        rest = {k: goals[k] - below[k] for k in ends}
        last, before, size = cut(tied, F.col("d_doc"), rest, ends, bins)
        same = tied.where(F.col("d_doc") == by_node(last, "long"))
        ends = {r["node"]: (r["lo"], r["hi"]) for r in same.groupBy("node").agg(F.min("d_row").alias("lo"), F.max("d_row").alias("hi")).collect()}
        rest = {k: rest[k] - before[k] for k in ends}
        row, before, own = cut(same, F.col("d_row"), rest, ends, bins)
        size |= own
        # the row that the goal falls into goes where the sizes end up closer
        row = {k: v - (k in size and rest[k] - before[k] < before[k] + size[k] - rest[k]) for k, v in row.items()}
        on_doc = (F.col("d_doc") < by_node(last, "long")) | ((F.col("d_doc") == by_node(last, "long")) & (F.col("d_row") <= by_node(row, "long")))
        left = (axis < by_node(at, "long")) | ((axis == by_node(at, "long")) & on_doc)
        rows = durable(rows.withColumn("node", F.when(F.col("node").isin(list(stats)), F.when(left, F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2)).otherwise(F.col("node")).cast("int")))
        for k in list(count):
            if (n := count[k]) > 1:
                first |= {2 * k + 1: first[k], 2 * k + 2: first[k] + n // 2}
                count |= {2 * k + 1: n // 2, 2 * k + 2: n - n // 2}
                del first[k], count[k]
    shard = F.coalesce(by_node(first, "int"), F.lit(0))
    out = rows.select("doc_id", "size", "text_crc32", "d_doc", "d_row", shard.alias("shard"), F.lit(1).alias("one"))
    return running_totals(out, ["shard"], ["d_doc", "size", "text_crc32", "d_row"], {"slot": "one"}).select("doc_id", "size", "text_crc32", "shard", "slot")


def target_shards(docs: DataFrame, target_bytes: int) -> int:
    """Leaves that bring the mean leaf to the target bytes."""
    total = docs.agg(F.sum(text_bytes() + 1)).first()[0] or 0
    return max(1, -(-total // target_bytes))
