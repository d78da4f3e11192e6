"""Engagement of visits and sensitivity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, urls, words
from . import containment, joins


def linked_urls(searches: DataFrame, visits: DataFrame, minutes: int, key: list[str]) -> DataFrame:
    """key, url: URLs visited in the minutes after a search of the same key, once each."""
    return joins.band(searches.select("us", *key), visits.select("us", "url", *key), key, minutes * 60_000_000).select(*[F.col(f"r_{k}").alias(k) for k in key], F.col("r_url").alias("url")).distinct()


def scores(visits: DataFrame, linked: DataFrame, key: list[str] = []) -> DataFrame:  # noqa: B006
    """visits with engagement: a long title, a revisit (of the same key), a search before and technical terms count."""
    title = words.clean_title(F.col("title"))
    n_words = F.size(F.filter(F.split(title, r"\s+"), lambda w: w != ""))
    seen = visits.groupBy(*key, "url").agg(F.count("*").alias("_n"))
    marks = seen.join(linked.withColumn("_linked", F.lit(True)), [*key, "url"], "left")  # one row for each URL, so the visits are shuffled once, or not at all
    rows = visits.join(marks, [*key, "url"])
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    total = part(n_words >= 5, 0.25) + part(F.col("_n") > 1, 0.20) + part(F.col("_linked").isNotNull(), 0.25) + part(title.rlike(rules.TECHNICAL), 0.15)
    return rows.withColumn("engagement", F.least(F.lit(1.0), total)).drop("_n", "_linked")


def sensitive(visits: DataFrame, dims: DataFrame, key: str = "seq") -> DataFrame:
    """visits with sensitive_category (null if none); dims: priority, category, pattern (a host, or host/path). Hosts match exactly or as a parent, paths by prefix."""
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    d = dims.select("priority", "category", F.substring_index("pattern", "/", 1).alias("_s"), F.when(F.col("pattern").contains("/"), F.regexp_replace("pattern", "^[^/]+", "")).otherwise("").alias("_p"))
    pages = visits.select(F.col("url").alias("_u"), host.alias("_h"), path.alias("_path")).distinct()
    cut = pages.select("_u", "_h", "_path", F.explode(urls.suffixes(F.col("_h"))).alias("_s"))
    met = cut.join(joins.sized(d), "_s").where(F.col("_path").startswith(F.col("_p")))
    # an exact host before a parent, a whole host before a path
    order = F.struct((F.col("_p") != "").alias("a"), (F.col("_h") != F.col("_s")).alias("b"), "priority", "category")
    best = met.groupBy("_u").agg(F.min_by("category", order).alias("sensitive_category"))
    return visits.join(best, visits["url"] == best["_u"], "left").drop("_u")


def redact(visits: DataFrame) -> DataFrame:
    """visits with sensitive_category: the marked ones lose their path and title."""
    hit = F.col("sensitive_category").isNotNull()
    return visits.withColumns({"url": F.when(hit, F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/[FILTERED]"))).otherwise(F.col("url")), "title": F.when(hit, F.concat(F.lit("["), "sensitive_category", F.lit("]"))).otherwise(F.col("title"))})


def drop_sensitive_searches(searches: DataFrame, dims: DataFrame) -> DataFrame:
    """Searches whose query contains no sensitive host; patterns with a path don't count."""
    return containment.without(searches, F.lower("query"), dims.where(~F.col("pattern").contains("/")).select(F.lower("pattern").alias("pattern")))
