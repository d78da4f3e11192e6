"""Events from all sources in one form, by rules or by a classifier that is passed in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, urls

RAW = "seq long, us long, source string, text string, category string, domain string"


def raw_visits(visits: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """visits with a category."""
    host = urls.host(F.col("url"))
    return visits.select("seq", "us", F.lit("browser").alias("source"), F.concat(host, F.lit(" - "), F.substring("title", 1, 80)).alias("text"), F.coalesce("category", F.lit("other")).alias("category"), host.alias("domain"), *more)


def raw_searches(searches: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    return searches.select("seq", "us", F.lit("search").alias("source"), F.concat(F.lit('"'), "query", F.lit('" ('), "engine", F.lit(")")).alias("text"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("domain"), *more)


def raw_prompts(prompts: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    return prompts.select("seq", "us", F.lit("claude").alias("source"), F.substring("prompt", 1, 150).alias("text"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("domain"), *more)


def raw_commits(commits: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    text = F.concat("repo", F.lit(": "), "message", F.lit(" (+"), F.col("insertions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(")"))
    return commits.select("seq", "us", F.lit("git").alias("source"), text.alias("text"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("domain"), *more)


def by_rules(raw: DataFrame) -> DataFrame:
    """Raw events with activity_type, topics, entities, intent, confidence and summary."""
    source, text, category = F.col("source"), F.col("text"), F.coalesce("category", F.lit("other"))
    query = F.regexp_replace(text, r'^"(.+)"\s*\(.*\)$', "$1")
    message = F.regexp_replace(F.regexp_replace(text, r"^\S+:\s+", ""), r"\s*\(\s*\+\s*[0-9]+\s*/\s*-\s*[0-9]+\s*\)\s*$", "")
    topic = F.when(source == "browser", rules.lookup(category, rules.CATEGORY_TOPICS, None)).when(source == "search", rules.search_topic(query)).when(source == "claude", rules.prompt_topic(text)).when(source == "git", rules.prompt_topic(message))
    activity = (
        F.when(source == "browser", rules.lookup(category, rules.ACTIVITIES, "unknown")).when(source == "search", "research")
        .when(source == "claude", rules.lookup(rules.task_type(text), rules.TASK_ACTIVITIES, "unknown")).when(source == "git", "implementation").otherwise("unknown")
    )
    rows = raw.withColumns({"topic": topic, "activity_type": activity, "intent": rules.intent(text, source), "entities": rules.entities(text, F.col("domain")), "confidence": F.lit(0.3)})
    t = F.col("topic")
    summary = (
        F.when(source == "search", F.when(t != "information", F.concat(F.lit("Searched for "), t)).otherwise("Performed online search"))
        .when(source == "git", F.coalesce(F.concat(F.lit("Committed "), t, F.lit(" changes")), F.lit("Committed code changes")))
        .when(source == "browser", rules.lookup(category, rules.CATEGORY_SUMMARIES, "Browsing web content")).otherwise(F.concat("activity_type", F.lit(" activity")))
    )
    topics = F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array(t))
    return rows.withColumns({"summary": summary, "topics": topics}).drop("topic")


def by_rules_once(raw: DataFrame) -> DataFrame:
    """by_rules, worked out once for each text with its source, category and domain."""
    given = ["source", "text", "category", "domain"]
    own = F.struct(*given).alias("_given")
    each = raw.select(*given).distinct().repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # rules cost time, not bytes
    ruled = by_rules(each)
    added = [c for c in ruled.columns if c not in given]
    joined = raw.withColumn("_own", own).join(ruled.select(own, *added), F.col("_own") == F.col("_given"))  # structs are equal where both have nulls
    return joined.select(*raw.columns, *added)


def gated(events: DataFrame) -> DataFrame:
    """Topics and entities only of events whose category bears them."""
    bears = F.coalesce("category", F.lit("other")).isin(*rules.ENTITY_CATEGORIES)
    none = F.array().cast("array<string>")
    return events.withColumns({c: F.when(bears, F.col(c)).otherwise(none) for c in ("topics", "entities")})


def by_model(raw: DataFrame, classifier: Callable[[list[str]], list[dict | None]], batch: int = 8) -> DataFrame:
    """Like by_rules, but activity_type, intent, confidence and summary are what the classifier says of a batch of texts; where it gives none or an unknown
    activity, the rules stand. The classifier is called in the tasks, batch by batch."""
    known, columns = {*rules.ACTIVITIES.values(), "debugging", "planning"}, ("activity_type", "intent", "confidence", "summary")
    ruled = by_rules_once(raw)
    text_at = ruled.columns.index("text")

    def work(batches):
        for b in batches:
            texts = b.column(text_at).to_pylist()
            said = [x for i in range(0, len(texts), batch) for x in exactly(classifier(texts[i : i + batch]), len(texts[i : i + batch]))]
            answers = [(i, x) for i, x in enumerate(said) if x and x.get("activity_type") in known]
            for c in columns:
                at = b.schema.get_field_index(c)
                values = b.column(at).to_pylist()
                for i, x in answers:
                    if x.get(c) is not None:
                        values[i] = min(1.0, max(0.0, float(x[c]))) if c == "confidence" else str(x[c])[:120]
                b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
            yield b

    return ruled.mapInArrow(work, ruled.schema)


def exactly(answers: list[dict | None], n: int) -> list[dict | None]:
    if len(answers) != n:
        raise ValueError(f"{len(answers)} answers to {n} texts")
    return answers


def decode(answer: Column) -> Column:
    """A model's JSON answer as a struct: known activities and intents only, confidence within 0 and 1, short lists and summary; null if it isn't JSON."""
    said = F.from_json(answer, "activityType string, topics array<string>, entities array<string>, intent string, confidence double, summary string")
    known = [*dict.fromkeys([*rules.ACTIVITIES.values(), "debugging", "planning"])]
    return F.when(
        said.isNotNull() & said["activityType"].isNotNull(),
        F.struct(
            F.when(said["activityType"].isin(*known), said["activityType"]).otherwise("unknown").alias("activity_type"), F.slice(F.coalesce(said["topics"], F.array()), 1, 3).alias("topics"), F.slice(F.coalesce(said["entities"], F.array()), 1, 5).alias("entities"),
            F.when(said["intent"].isin(*[x for _, x in rules.INTENTS], "explore"), said["intent"]).otherwise("explore").alias("intent"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(said["confidence"], F.lit(0.5)))).alias("confidence"), F.substring(said["summary"], 1, 120).alias("summary"),
        ),
    )
