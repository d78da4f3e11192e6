"""What a period's events have in common: focus, distributions, pairs and recurrence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import containment


def topic_focus(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, focus: one minus the entropy of topic mentions over its maximum."""
    counts = events.select(*keys, F.explode("topics").alias("t")).groupBy(*keys, F.lower("t").alias("t")).agg(F.count("*").alias("n"))
    per_key = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = F.log2("all") - F.col("nlogn") / F.col("all")
    return per_key.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy / F.log2(F.greatest(F.lit(2), F.col("kinds"))))).alias("focus"))


def concentration(events: DataFrame, keys: list[str]) -> DataFrame:
    counts = events.groupBy(*keys, "activity_type").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("concentration"), F.sum("n").alias("n_events"))


def compress(blended: Column) -> Column:
    """Onto 0.30 to 0.98 along a sigmoid."""
    low, high = 1 / (1 + math.exp(2.5)), 1 / (1 + math.exp(-2.5))
    return F.lit(0.30) + F.lit(0.98 - 0.30) * (1 / (1 + F.exp(-5 * (blended - 0.5))) - low) / (high - low)


def focus_score(events: DataFrame, keys: list[str]) -> DataFrame:
    both = concentration(events, keys).join(topic_focus(events, keys), keys, "left")
    score = compress(0.6 * F.coalesce("focus", F.lit(0.0)) + 0.4 * F.col("concentration"))
    label = F.when(F.col("score") >= 0.75, "Highly focused").when(F.col("score") >= 0.60, "Moderately focused").when(F.col("score") >= 0.45, "Varied").otherwise("Widely scattered")
    return both.select(*keys, "n_events", score.alias("score")).withColumn("label", label)


def activity_distribution(events: DataFrame) -> DataFrame:
    counts = events.groupBy("activity_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) + 0.5).cast("long"))


def pairs(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """a < b for each unordered pair of a row's distinct items."""
    left = df.select(*keys, items, F.explode(F.array_distinct(items)).alias("a"))
    return left.select(*keys, "a", F.explode(F.filter(F.array_distinct(items), lambda x: x > F.col("a"))).alias("b"))


def first_of_each(df: DataFrame, by: list[str], order: list, top: int | None) -> DataFrame:
    """The top rows of each key (of all, without keys)."""
    if top is None:
        return df
    if not by:
        return df.orderBy(*order).limit(top)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= top).drop("_n")


def cooccurrences(windowed: DataFrame, keys: list[str], top: int | None = 20, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by (some of the keys, each with its own pairs), a, b, shared (windows with both), strength (share of the largest), first_us; windowed: keys, window, anchor_us, topics. Windows of one event don't count.

    A window's topics are distinct before pairing, so a window makes no more pairs than topics allow."""
    whole = windowed.groupBy(*keys, "window").agg(F.count("*").alias("n"), F.min("anchor_us").alias("anchor_us"), F.array_distinct(F.flatten(F.collect_set("topics"))).alias("topics")).where("n > 1")
    counts = pairs(whole, [*by, "anchor_us"], "topics").groupBy(*by, "a", "b").agg(F.count("*").alias("shared"), F.min("anchor_us").alias("first_us"))
    out = counts.withColumn("strength", F.col("shared") / F.max("shared").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))
    return first_of_each(out, by, [F.desc("shared"), "first_us", "a", "b"], top)


def entity_relations(events: DataFrame, least: int = 3, top: int | None = 15, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, a, b, n (events with both), contexts: pairs with enough support that aren't unknown throughout."""
    out = pairs(events, [*by, "activity_type"], "entities").groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("activity_type")).alias("contexts"))
    out = out.where((F.col("n") >= least) & ~F.forall("contexts", lambda c: c == "unknown"))
    return first_of_each(out, by, [F.desc("n"), "a", "b"], top)


def novel_entities(entities: DataFrame, topics: DataFrame) -> DataFrame:
    """Entities that are part of no recurring topic."""
    marked = entities.withColumn("_name", F.lower("entity"))
    found = containment.contained(topics.select(F.lower("topic").alias("text")), marked.select(F.col("_name").alias("pattern"))).select(F.col("pattern").alias("_found")).distinct()
    return marked.join(found, F.col("_name") == F.col("_found"), "left_anti").drop("_name")


def tag_scores(clusters: DataFrame, relations: DataFrame, least: float = 0.1, top: int = 10) -> DataFrame:
    """tag, score of topics by intensity and entities by support, each relative to its largest."""
    one = Window.partitionBy(F.lit(1))
    topics = clusters.select(F.explode("topics").alias("tag"), "intensity").groupBy("tag").agg(F.max("intensity").alias("s"))
    topics = topics.select("tag", (F.col("s") / F.max("s").over(one)).alias("score"))
    things = relations.select(F.explode(F.array("a", "b")).alias("tag"), "n").groupBy("tag").agg(F.max("n").alias("s"))
    things = things.select("tag", (F.col("s") / F.max("s").over(one)).alias("score"))
    return topics.unionByName(things).groupBy("tag").agg(F.max("score").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "tag").limit(top)
