"""Sessions, hour islands, anchored windows and chains over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, words
from .ordered import durable, walked


def gap_sessions(df: DataFrame, keys: list[str], minutes: int, by_day: bool = True) -> DataFrame:
    """df with session (from 1 in each key): a new one when the gap exceeds the minutes, or the day changes. A missing time never splits."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("us", F.lit(0)), "seq")
    before = F.lag("us").over(order)
    day = lambda c: F.floor(c / 86_400_000_000)
    split = (F.col("us") - before > minutes * 60_000_000) | (F.lit(by_day) & (day(F.col("us")) != day(before)))
    flags = df.withColumn("_new", F.coalesce(split, F.lit(False)).cast("int"))
    return flags.withColumn("session", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("_new")


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the first seen among equals, and its count."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "_n"), F.struct(-F.col("_n"), F.col("_first"))).alias("_x")).select(*keys, F.col(f"_x.{value}").alias(value), F.col("_x._n").alias("n"))


def hour_islands(events: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of hours with the same dominant activity, hours at most one apart: keys, activity_type, hour_start, hour_end, event_count."""
    totals = events.groupBy(*keys, "hour").agg(F.count("*").alias("n_events"))
    main = dominant(events, [*keys, "hour"], "activity_type").drop("n").join(totals, [*keys, "hour"])
    order = Window.partitionBy(*keys, "activity_type").orderBy("hour")
    rows = main.withColumn("_island", F.col("hour") - F.row_number().over(order))
    out = rows.groupBy(*keys, "activity_type", "_island").agg(F.min("hour").alias("hour_start"), F.max("hour").alias("hour_end"), F.sum("n_events").alias("event_count"))
    return out.drop("_island")


def described_islands(islands: DataFrame, events: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """islands with topics, entities (of their hours' events, in the order in which they come, the first few), intensity (events an hour) and label.

    Topics and entities are combined by name before they are gathered: a list has one entry for each name, not for each event."""
    hours = islands.withColumn("hour", F.explode(F.sequence("hour_start", "hour_end"))).select(*keys, "hour", "activity_type", "hour_start")
    at = [*keys, "activity_type", "hour_start"]
    mine = events.select(*keys, "hour", "us", "seq", "topics", "entities").join(hours, [*keys, "hour"])

    def named(column: str) -> DataFrame:
        first = mine.select(*at, "us", "seq", F.posexplode(column).alias("i", "name")).groupBy(*at, "name").agg(F.min(F.struct("us", "seq", "i")).alias("first"))
        return first.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("first", "name"))).alias("x")).select(*at, F.transform("x", lambda x: x["name"]).alias(column))

    out = islands.join(named("topics"), at, "left").join(named("entities"), at, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"topics": words.keep_topics(F.coalesce("topics", none)), "entities": F.slice(F.coalesce("entities", none), 1, most), "intensity": F.col("event_count") / (F.col("hour_end") - F.col("hour_start") + 1)})
    tail = F.when(F.size("topics") > 0, F.concat(F.lit(": "), F.array_join(F.slice("topics", 1, 3), ", "))).otherwise("")
    label = F.concat("activity_type", F.lit(" "), words.hour_label(F.col("hour_start")), F.lit("-"), words.hour_label(F.col("hour_end") + 1), tail)
    return out.withColumn("label", label).withColumn("topics", F.slice("topics", 1, most))


def stretches(df: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """df with _stretch: its events follow each other by the minutes at most, so what depends on nearness never leaves it."""
    return gap_sessions(df, keys, minutes, by_day=False).withColumnRenamed("session", "_stretch")


def numbered_after(parts: DataFrame, keys: list[str], number: str, size: str) -> DataFrame:
    """parts (one row for each key and stretch) with _before: the sum of size over the stretches before."""
    order = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_stretch", F.coalesce(F.sum(size).over(order), F.lit(0)).alias(number))


def anchored_windows(df: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """keys, seq, window (from 0), anchor_us: a window opens at its first event and takes what comes within the minutes, the last included.

    A gap of more than the minutes always opens a window, so keys are first cut into stretches without one; only the times and numbers of a stretch are folded together."""
    rows = stretches(df.where("us is not null").select(*keys, "us", "seq"), keys, minutes)
    items = rows.groupBy(*keys, "_stretch").agg(F.sort_array(F.collect_list(F.struct("us", "seq"))).alias("e"))
    fold = f"""aggregate(e, named_struct('w', -1L, 'a', cast(null as bigint), 'out', cast(array() as array<struct<at: bigint, anchor_us: bigint>>)),
      (s, x) -> if(s.a is null or x.us - s.a > {minutes * 60_000_000}L, named_struct('w', s.w + 1, 'a', x.us, 'out', concat(s.out, array(named_struct('at', s.w + 1, 'anchor_us', x.us)))), s), s -> s.out)"""
    folded = items.withColumn("_windows", F.expr(fold))
    before = numbered_after(folded.select(*keys, "_stretch", F.size("_windows").alias("_n")), keys, "_before", "_n")
    found = folded.select(*keys, "_stretch", F.explode("e").alias("x"), "_windows").withColumn("_w", F.element_at(F.filter("_windows", lambda w: w.anchor_us <= F.col("x.us")), -1))
    return found.join(before, [*keys, "_stretch"]).select(*keys, F.col("x.seq").alias("seq"), (F.col("_before") + F.col("_w.at")).alias("window"), F.col("_w.anchor_us").alias("anchor_us"))


def search_missions(searches: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """keys, seq, mission (from 0): a query joins the chain if it comes within the minutes of the one before and shares a content word (column content) with the chain's first.

    A longer gap always ends a chain, so keys are first cut into stretches without one, and only a stretch is folded together; all stretches of a partition are folded in one call."""
    rows = stretches(searches.select(*keys, "seq", "us", "content"), keys, minutes)

    def walk():
        def follow(members: list[tuple]) -> list[int]:
            out, mission, opener = [], -1, set()
            for _, _, content in members:
                found = set(content)
                if mission < 0 or not opener & found:
                    mission, opener = mission + 1, found
                out.append(mission)
            return out

        return follow

    found = durable(walked(rows, [*keys, "_stretch"], ["us", "seq"], "content", walk, [*keys, "_stretch", "seq"], "mission"))
    before = numbered_after(found.groupBy(*keys, "_stretch").agg((F.max("mission") + 1).alias("_n")), keys, "_before", "_n")
    return found.join(before, [*keys, "_stretch"]).select(*keys, "seq", (F.col("mission") + F.col("_before")).alias("mission"))


def opener_and_turns(df: DataFrame, file: str) -> DataFrame:
    """Whether a row opens its conversation, and how many rows that has."""
    return df.withColumn("is_opener", F.row_number().over(Window.partitionBy(file).orderBy("us", "seq")) == 1).withColumn("turn_count", F.count("*").over(Window.partitionBy(file)))


def minute_bucket(us: Column) -> Column:
    return F.coalesce(F.floor(us / 60_000_000), F.lit(0))


def work_units(commits: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """keys, repo, session, debug: sessions of a repository, bug fixing apart from the rest, with commits, insertions, deletions, start_us, end_us, is_generic, work_mode (the most
    frequent one that isn't tweaking), label (the most frequent scope, or the repository and the mode) and why (the first reason given)."""
    m = F.col("message")
    rows = gap_sessions(commits, [*keys, "repo"], minutes).withColumns({"mode": rules.work_mode(m, F.col("insertions"), F.col("deletions")), "scope": rules.commit_scope(m), "reason": rules.why_clause(m)})
    rows = rows.withColumn("debug", F.col("mode") == "debugging")
    at = [*keys, "repo", "session", "debug"]
    units = rows.groupBy(*at).agg(
        F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.bool_and(rules.is_generic(m)).alias("is_generic"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("us", "seq"))).alias("why"),
    )
    mode = dominant(rows.where("mode <> 'tweaking'"), at, "mode").drop("n")
    scope = dominant(rows.where("scope is not null"), at, "scope").drop("n")
    out = units.join(mode, at, "left").join(scope, at, "left").withColumn("work_mode", F.coalesce("mode", F.lit("tweaking")))
    label = F.coalesce(F.concat(F.lit("Feature work: "), "scope"), F.concat("repo", F.lit(": "), "work_mode"))
    return out.withColumn("label", label).drop("mode", "scope")
