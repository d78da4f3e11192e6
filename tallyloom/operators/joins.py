"""Joins by rule, by band and by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from . import containment
from .ordered import sized

def by_domain_rule(rows: DataFrame, rules: DataFrame, host: str = "domain", key: str = "seq") -> DataFrame:
    """rows with category (null without a match): rules (priority, category, pattern, kind) match a host exactly or as its parent (kind exact), as a parent only (suffix), or by its
    first label (prefix). The rule of the least priority wins. Hosts are taken once each; each is cut into its suffixes, so all matches are equi-joins."""
    hosts = rows.select(F.col(host).alias("_h")).distinct()
    cut = hosts.select("_h", F.explode(urls.suffixes(F.col("_h"))).alias("pattern"))
    dims = sized(rules)
    tail = cut.join(dims.where("kind in ('exact', 'suffix')"), "pattern").where("kind = 'exact' or _h <> pattern")
    head = hosts.select("_h", F.substring_index("_h", ".", 1).alias("pattern")).join(dims.where("kind = 'prefix'"), "pattern")
    found = tail.select("_h", "priority", "category").unionByName(head.select("_h", "priority", "category"))
    best = found.groupBy("_h").agg(F.min_by("category", F.struct("priority", "category")).alias("category"))
    return rows.join(best, rows[host] == best["_h"], "left").drop("_h")


def band(left: DataFrame, right: DataFrame, key: list[str], width_us: int, left_until: str | None = None) -> DataFrame:
    """Pairs with equal keys and 0 <= right.us - left.us <= width (or right.us <= left_until + width); left columns get the prefix l_, right ones r_.

    Times are cut into buckets of the width; a left row stands in each bucket that its band touches, so the join is an equi-join with a residual."""
    until = F.col(f"l_{left_until}") if left_until else F.col("l_us")
    l = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])  # noqa: E741
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_b", F.floor(F.col("r_us") / width_us))
    l = l.withColumn("_b", F.explode(F.sequence(F.floor(F.col("l_us") / width_us), F.floor((until + width_us) / width_us))))  # noqa: E741
    on = [l["_b"] == r["_b"], *[l[f"l_{k}"] == r[f"r_{k}"] for k in key]]
    pairs = l.join(r, on)
    return pairs.where((F.col("r_us") >= F.col("l_us")) & (F.col("r_us") <= until + width_us)).drop("_b")


def link_searches(searches: DataFrame, visits: DataFrame, minutes: int, key: list[str]) -> DataFrame:
    """Each search with the number of visits in the minutes after it, and whether it was directed (two at most)."""
    pairs = band(searches.select("seq", "us", *key), visits.select("seq", "us", *key), key, minutes * 60_000_000)
    n = pairs.groupBy(F.col("l_seq").alias("seq")).agg(F.count("*").alias("n_visits"))
    out = searches.join(n, "seq", "left").withColumn("n_visits", F.coalesce("n_visits", F.lit(0)))
    return out.withColumn("intent_type", F.when(F.col("n_visits") <= 2, "directed").otherwise("undirected"))


def with_rank(hosts: DataFrame, ranks: DataFrame) -> DataFrame:
    """rank of the host, or else of its parent domain."""
    own = ranks.select(F.col("domain").alias("_d"), F.col("rank").alias("_own"))
    up = ranks.select(F.col("domain").alias("_p"), F.col("rank").alias("_up"))
    rows = hosts.withColumn("_parent", F.regexp_replace("domain", r"^[^.]+\.", ""))
    rows = rows.join(own, rows["domain"] == own["_d"], "left").join(up, rows["_parent"] == up["_p"], "left")
    return rows.withColumn("rank", F.coalesce("_own", "_up")).drop("_d", "_own", "_p", "_up", "_parent")


def not_covered(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (domain) that neither contain nor are contained in a known pattern."""
    return containment.neither_way(candidates, F.col("domain"), known)


def first_interval(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows (hour) with the first interval (n, hour_start, hour_end) that holds the hour: intervals are opened into their hours, 24 at most."""
    opened = intervals.select("n", F.explode(F.sequence("hour_start", "hour_end")).alias("hour")).groupBy("hour").agg(F.min("n").alias("n"))
    return rows.join(F.broadcast(opened), "hour", "left")


def diff_next(df: DataFrame, order: str, column: str) -> DataFrame:
    """What each row of an ordered small table gains and loses against the next one."""
    after = F.lead(column).over(Window.orderBy(order))
    return df.withColumn("_next", after).where("_next is not null").select(order, F.sort_array(F.array_except("_next", column)).alias("added"), F.sort_array(F.array_except(column, "_next")).alias("removed"))
