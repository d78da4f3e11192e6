"""Deduplication and top-k per group, by window functions with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls, words


def best_per_key(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The row with the most telling title, then the earliest (no time last), then the first, and how many rows it stands for (copies).

    An aggregate of one struct, so copies are combined before the shuffle and a hot key stays small."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    late = F.coalesce(F.col("us"), F.lit(2**62))
    pick = F.struct((-words.title_rank(F.col("title"))).alias("r"), late.alias("t"), F.col("seq").alias("s"), F.struct(*df.columns).alias("row"))
    rows = df.select(*named, pick.alias("_p"))
    return rows.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_p").alias("_p"), F.count("*").alias("copies")).select("_p.row.*", "copies")


def collapse_near_duplicates(visits: DataFrame) -> DataFrame:
    """One visit for each canonical URL and minute."""
    minute = F.coalesce(F.floor(F.col("us") / 60_000_000), F.lit(0))
    return best_per_key(visits, [urls.canonical_key(F.col("url")), minute])


def dedup_visits(visits: DataFrame, per_domain: int) -> DataFrame:
    """One visit for each canonical URL, then the latest `per_domain` of each host."""
    kept = best_per_key(visits, [urls.canonical_key(F.col("url"))]).withColumn("domain", urls.host(F.col("url")))
    return top_k(kept.where("domain <> ''"), ["domain"], [F.coalesce("us", F.lit(0)).desc(), F.col("seq")], per_domain)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark's group limit cuts before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("_n = 1").drop("_n", *names)


def prompt_key(prompt: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.substring(prompt, 1, 60)), r"\s+", " "))


def follow_redirects(visits: DataFrame) -> DataFrame:
    """Redirects become visits of where they lead, unless that page was visited anyway; the first redirect to a page counts."""
    target = urls.unwrap_redirect(F.col("url"))
    plain = visits.where(target.isNull())
    moved = visits.withColumn("url", target).where("url is not null")
    seen = plain.select(urls.canonical_key(F.col("url")).alias("_key")).distinct()
    new = moved.withColumn("_key", urls.canonical_key(F.col("url"))).join(seen, "_key", "left_anti")
    return plain.unionByName(first_per_key(new, [F.col("_key")], [F.col("us").desc(), F.col("seq")]).select(visits.columns))
