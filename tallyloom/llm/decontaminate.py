"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes a row of tokens. A run of digits turns into the placeholder `§n`, a unit of measure behind a number into `§u`, a capitalised word
inside a sentence (behind a lower-case letter, a digit, or one of `,;:`, and one white space) into `§m`; what is left is lower-cased and cut at all that is
no letter, mark or digit. Every window of `window` template tokens of every benchmark item is looked up in the windows of all texts by its hash.
The matches of a document and an item that lie on one diagonal (same offset) form a passage. In a passage, the templates must be equal token by
token, and the slots must be consistent: a value of the item always meets the same value in the document. So `3 kg ... 3 kg` matches `5 kg ... 5 kg`, not
`5 kg ... 7 kg`. An inconsistent passage is judged again by its runs of consecutive windows: a run that is consistent by itself is a passage, and of another
run, the windows whose slots are all unchanged (verbatim copies) are one. So one edited number does not clear a copied item.
A document with a consistent passage is contaminated; if a slot's value differs, the passage is re-parameterised.

An item of fewer tokens than `window` is looked up whole if it has `least` tokens or more; shorter ones are too common to tell and match nothing.
Null and empty texts match nothing. Repeated items count separately, as do repeated documents: each row of the table gives one result row, judged by its own text, also
where its doc_id is missing or shared. An empty table of documents gives no rows, an empty benchmark leaves all documents clean. Other columns are ignored.

Benchmark windows are broadcast while there are at most `broadcast_windows` of them, beyond that they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, sized, text_bytes

#: Units of measure that become a placeholder behind a number.
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "in", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "years", "year", "euros", "euro", "dollars", "dollar", "usd", "eur", "percent", "miles", "meters", "metres", "km2", "m2", "kwh", "w", "kw", "v", "hz", "mb", "gb")
NAME = r"([\p{Ll}\p{Nd},;:]\s)(\p{Lu}[\p{L}\p{M}]*)"
UNIT = r"(§n[0-9]+ +)(" + "|".join(UNITS) + r")([^\p{L}\p{M}\p{Nd}]|$)"
BREAK = r"[^\p{L}\p{M}\p{Nd}§]+"


def slotted(text: Column) -> Column:
    """Tokens joined by a space; a placeholder is followed by its value."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "§", " ")
    for _ in range(2):  # the second time for a name right behind a name
        x = F.regexp_replace(x, NAME, "$1§m$2")
    x = F.lower(F.regexp_replace(x, "([0-9]+)", " §n$1 "))
    x = F.regexp_replace(x, UNIT, "$1§u$2$3")
    return F.trim(F.regexp_replace(x, BREAK, " "))


def template(slots: Column) -> Column:
    return F.regexp_replace(slots, "§([nmu])[^ ]+", "§$1")


def tokens(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def window_hashes(words: Column, size: int, fits: Column) -> Column:
    """size, at and hash of all windows of this size, if it fits."""
    last = F.size(words) - size
    one = lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(F.slice(words, i + 1, size)).alias("hash"))
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)
    return F.when(fits & (last >= 0), every).otherwise(F.array().cast("array<struct<size:int,at:int,hash:bigint>>"))


def passages(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 5, broadcast_windows: int = 500_000) -> DataFrame:
    """doc_id, item_id (a struct of the item's id and its text's hash, so items without an id and texts that share one stay apart), windows, consistent, altered: one row for each document, item and
    diagonal with a match, or for each run of it if the whole is inconsistent."""
    items = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("tie")).alias("item_id"), slotted(F.col("text")).alias("slots")).select("item_id", "slots", tokens(template(F.col("slots"))).alias("words"))
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window))).where(F.col("size") >= least)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    texts = docs.select("doc_id", slotted(F.col("text")).alias("slots"))

    def hashed(df: DataFrame, key: str, own: Column | None = None) -> DataFrame:
        by_size = [window_hashes(F.col("words"), n, F.lit(True) if own is None else own == n) for n in sizes]
        return df.select(key, F.explode(F.concat(*by_size)).alias("w")).select(key, "w.*")

    if not sizes:
        return docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in {"item_id": items.schema["item_id"].dataType, "windows": "long", "consistent": "boolean", "altered": "boolean"}.items()]).where("false")
    wanted = durable(hashed(items, "item_id", F.col("size"))).withColumnRenamed("at", "item_at")
    small = wanted.count() <= broadcast_windows
    have = hashed(texts.select("doc_id", tokens(template(F.col("slots"))).alias("words")), "doc_id")
    hits = have.join(F.broadcast(wanted) if small else wanted, ["size", "hash"])
    runs = hits.groupBy("doc_id", "item_id", "size", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("starts"))
    runs = durable(runs)
    found = docs.select("doc_id", "text").join(sized(runs.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates()
    found = found.select("doc_id", tokens(slotted(F.col("text"))).alias("d"))
    lined = runs.join(items.select("item_id", tokens(F.col("slots")).alias("i")).distinct(), "item_id").join(found, "doc_id")
    lined = lined.withColumn("starts", F.sort_array("starts"))
    kind = lambda w: F.when(w.startswith("§"), F.substring(w, 1, 2)).otherwise(w)

    def judged(some: DataFrame) -> DataFrame:
        at = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1))))
        paired = some.withColumn("pairs", F.transform(at, lambda p: F.struct(F.get("i", p).alias("i"), F.get("d", p + F.col("shift")).alias("d"))))
        same = F.forall("pairs", lambda x: kind(x.d).eqNullSafe(kind(x.i)))
        slots = F.array_distinct(F.filter("pairs", lambda x: x.i.startswith("§")))
        one_to_one = F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda x: x.i)))
        return paired.withColumn("consistent", same & one_to_one).withColumn("altered", F.exists(slots, lambda x: x.i != x.d)).drop("pairs")

    row = ["doc_id", "item_id", F.size("starts").cast("long").alias("windows"), "consistent", "altered"]
    whole = durable(judged(lined))  # texts with a match only
    broken = whole.where(~F.col("consistent")).drop("consistent", "altered")
    heads = F.filter("starts", lambda s, k: (k == 0) | (F.get("starts", k - 1) != s - 1))
    parts = broken.withColumn("heads", heads).select("*", F.posexplode("heads").alias("k", "head")).withColumn("next", F.get("heads", F.col("k") + 1))
    parts = parts.withColumn("starts", F.filter("starts", lambda s: (s >= F.col("head")) & (F.col("next").isNull() | (s < F.col("next"))))).drop("heads", "k", "head", "next")
    parts = judged(parts)
    copied = F.filter("starts", lambda s: F.slice("i", s + 1, F.col("size")) == F.slice("d", s + F.col("shift") + 1, F.col("size")))
    verbatim = parts.where(~F.col("consistent")).withColumn("starts", copied).withColumn("consistent", F.size("starts") > 0).withColumn("altered", F.lit(False))
    return whole.where("consistent").select(row).unionByName(parts.where("consistent").select(row)).unionByName(verbatim.select(row))


def row_key() -> Column:
    """What tells rows apart: doc_id, size and hash of the text; structs are equal where both have nulls."""
    return F.struct("doc_id", text_bytes().alias("size"), F.xxhash64("text").alias("tie"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """For each document: doc_id, contaminated, reparameterised, n_items, n_windows (of the longest passage), item_ids (array, ascending). Each row is judged by its own text. All items
    without an id count as one; item_ids leaves it out."""
    rows = docs.select(row_key().alias("doc_id"), "text")
    good = passages(rows, benchmark, **parameters).where("consistent")
    per_item = good.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.bool_and("altered").alias("altered"))
    ids = F.sort_array(F.collect_set("item_id.item_id")).alias("item_ids")
    nameless = F.max(F.col("item_id.item_id").isNull().cast("int")).alias("nameless")
    per_doc = durable(per_item.groupBy("doc_id").agg(ids, nameless, F.max("windows").alias("n_windows"), F.bool_or("altered").alias("altered")))
    out = rows.select("doc_id").join(sized(per_doc), "doc_id", "left")
    return out.select("doc_id.doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("altered", F.lit(False)).alias("reparameterised"), F.coalesce(F.size("item_ids") + F.col("nameless"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents, with all their columns, that are not contaminated. Each row is judged by its own text, whatever its doc_id."""
    bad = passages(docs.select(row_key().alias("doc_id"), "text"), benchmark, **parameters).where("consistent")
    name = fresh(docs.columns, "_bad")
    bad = durable(bad.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(sized(bad), row_key() == F.col(name), "left_anti")
