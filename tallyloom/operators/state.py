"""Topics over days: signals of one day against the history, and the history's update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TOPIC_STATE

KEPT_DAYS = 30


def empty_history(spark) -> DataFrame:
    return spark.createDataFrame([], TOPIC_STATE)


def trend(day: Column) -> Column:
    recent = F.size(F.filter("recent_days", lambda d: d >= F.date_sub(day, 14)))
    return F.when(F.col("last_seen").isNull(), "new").when(F.col("last_seen") < F.date_sub(day, 7), "returning").when(recent >= 5, "stable").when(recent >= 3, "rising").otherwise("declining")


def recurrence(topics: DataFrame, history: DataFrame, day: Column) -> DataFrame:
    """topic, frequency, trend, first_seen, prev_last_seen of the day's topics (column topic)."""
    today = topics.select(F.lower(F.trim("topic")).alias("topic")).where("topic <> ''").distinct()
    return today.join(history, "topic", "left").select("topic", (F.coalesce("day_count", F.lit(0)) + 1).alias("frequency"), trend(day).alias("trend"), F.coalesce("first_seen", day).alias("first_seen"), F.col("last_seen").alias("prev_last_seen"))


def update(history: DataFrame, topics: DataFrame, day: Column) -> DataFrame:
    """The history with the day's topics; a day that it already has changes nothing."""
    today = topics.select(F.lower(F.trim("topic")).alias("topic")).where("topic <> ''").distinct().withColumn("_day", day)
    both = history.join(today, "topic", "full")
    new = F.col("_day").isNotNull() & ~F.coalesce(F.array_contains("recent_days", F.col("_day")), F.lit(False))
    days = F.when(new, F.array_append(F.coalesce("recent_days", F.array().cast("array<date>")), F.col("_day"))).otherwise(F.col("recent_days"))
    kept = F.sort_array(F.filter(days, lambda d: d >= F.date_sub(day, KEPT_DAYS)))
    kept = F.when(F.size(kept) > KEPT_DAYS, F.slice(kept, -KEPT_DAYS, KEPT_DAYS)).otherwise(kept)
    return both.select("topic", F.least("first_seen", "_day").alias("first_seen"), F.greatest("last_seen", "_day").alias("last_seen"), (F.coalesce("day_count", F.lit(0)) + new.cast("int")).alias("day_count"), kept.alias("recent_days"))


#: What a report of recurring topics begins with.
TRENDS = ("new", "returning", "rising", "stable", "declining")


def by_trend(signals: DataFrame) -> list[Column]:
    """The order of a report: new and returning topics first, then the more frequent."""
    return [F.array_position(F.array(*map(F.lit, TRENDS)), F.col("trend")), F.desc("frequency"), F.col("topic")]
