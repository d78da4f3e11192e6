"""The stateful parts as Structured Streaming jobs over a stream of rows with an event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls


def suppress_near_duplicates(visits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first visit (time, url) of each canonical URL and minute; state is dropped behind the watermark."""
    keyed = visits.withWatermark("time", late).withColumns({"_key": urls.canonical_key(F.col("url")), "_minute": F.floor(F.unix_timestamp("time") / 60)})
    return keyed.dropDuplicatesWithinWatermark(["_key", "_minute"]).drop("_key", "_minute")


def sessions(events: DataFrame, key: str, gap: str = "90 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n of gap sessions, once the watermark has passed them."""
    grouped = events.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def topic_days(topics: DataFrame, kept_days: int = 30) -> DataFrame:
    """topic, day_count, last_seen after each batch in which a topic gets a new day; input topic, day (date). A repeated day changes nothing."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, days = state.get if state.exists else (0, [])
        days = list(days)
        new = sorted({str(d) for f in frames for d in f["day"]} - set(days))
        if new:
            n, days = n + len(new), sorted([*days, *new])[-kept_days:]
            state.update((n, days))
            yield pd.DataFrame({"topic": [key[0]], "day_count": [n], "last_seen": [days[-1]]})

    return topics.groupBy("topic").applyInPandasWithState(work, "topic string, day_count long, last_seen string", "n long, days array<string>", "update", GroupStateTimeout.NoTimeout)


def in_time_order(rows: DataFrame, key: str, late: str, values: list[str], out: str, memory: str, start: tuple, step: Callable) -> DataFrame:
    """Folds the rows (key, time, seq, the string columns of values) of each key in the order of time and seq, once the watermark has passed them, whatever order they come in.

    step(memory, time in microseconds, *values) gives the next memory and the values of the row's output; a key's state is its memory and the rows that wait. Rows behind the watermark are dropped, as everywhere in streams.
    A key is woken by a timer when the watermark reaches its next waiting row."""

    def work(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *known, times, seqs, texts = state.get if state.exists else (*start, [], [], [])
        waiting, mark, found = list(zip(times, seqs, texts, strict=True)), state.getCurrentWatermarkMs() * 1000, []
        for f in frames:
            us = f["time"].astype("datetime64[us]").astype("int64")
            joined = map(UNIT.join, zip(*[f[v].fillna("") for v in values], strict=True)) if values else [""] * len(f)
            new = zip(us.tolist(), f["seq"].tolist(), joined, strict=True)
            waiting += [x for x in new if x[0] > mark]  # Spark itself lets rows pass that are late by this batch's watermark but not by the last one's
        waiting.sort()
        while waiting and waiting[0][0] <= mark:
            time, seq, text = waiting.pop(0)
            known, row = step(known, time, *(text.split(UNIT) if values else []))
            found.append((of[0], seq, *row))
        state.update((*known, *([list(x) for x in zip(*waiting, strict=True)] or [[], [], []])))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    kind = dict(rows.dtypes)
    schema = f"{key} {kind[key]}, seq long, {out}"
    held = f"{memory}, times array<long>, seqs array<long>, texts array<string>"
    return rows.withWatermark("time", late).select(key, "time", "seq", *values).groupBy(key).applyInPandasWithState(work, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


#: Between the values of a waiting row, and between words; texts do not hold them.
UNIT, WORD = "\x1e", "\x1f"


def anchored_windows(events: DataFrame, key: str, minutes: int, late: str = "10 minutes") -> DataFrame:
    """key, seq, window (from 0), anchor_us of events (key, time, seq): a window opens at its first event and takes what comes within the minutes, the last included."""

    def step(known: list, time: int) -> tuple[list, tuple]:
        window, anchor = known
        if window < 0 or time - anchor > minutes * 60_000_000:
            window, anchor = window + 1, time
        return [window, anchor], (window, anchor)

    return in_time_order(events, key, late, [], "window long, anchor_us long", "window long, anchor long", (-1, 0), step)


def search_missions(searches: DataFrame, key: str, minutes: int, late: str = "10 minutes") -> DataFrame:
    """key, seq, mission (from 0) of searches (key, time, seq, content: array of words): a query joins the chain if it comes within the minutes of the one before and shares a word with the chain's first."""

    def step(known: list, time: int, text: str) -> tuple[list, tuple]:
        mission, last, opener = known
        found = set(text.split(WORD)) - {""}
        if mission < 0 or time - last > minutes * 60_000_000 or not found & set(opener):
            mission, opener = mission + 1, sorted(found)
        return [mission, time, opener], (mission,)

    rows = searches.withColumn("content", F.array_join("content", WORD))
    return in_time_order(rows, key, late, ["content"], "mission long", "mission long, last long, opener array<string>", (-1, 0, []), step)
