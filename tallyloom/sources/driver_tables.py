"""Logical tables of activity over the star schema: visits, searches, prompts, commits and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    """Microseconds since 1970 of a time, as its own clock shows it, whatever the session's time zone."""
    days = F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000_000 + (F.hour(column) * 3600 + F.minute(column) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, user_id, us (the time in microseconds), url, title: views and clicks, each of the page that its number falls on."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", "ts")
    keyed = events.withColumn("page_id", F.col("event_id") % F.lit(max(1, pages.count())))
    return keyed.join(pages, "page_id").select(F.col("event_id").alias("seq"), "user_id", micros().alias("us"), "url", "title")


def visits_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visits and four variants of each: a query, a fragment, a www. host, and a reload 20 seconds later. variant (0 to 4) makes seq unique."""
    v = visits(spark, sf_dir)
    bare = F.regexp_extract("url", "^([^?#]*)", 1)
    forms = (F.col("url"), F.concat(bare, F.lit("?v=1")), F.concat(bare, F.lit("#x")), F.regexp_replace("url", "^([a-z]+://)", "$1www."), F.col("url"))
    variants = F.array(*[F.struct(F.lit(i).alias("variant"), u.alias("u"), F.lit(20_000_000 * (i == 4)).alias("late")) for i, u in enumerate(forms)])
    out = v.select("seq", "user_id", "us", "title", F.explode(variants).alias("x"))
    us = F.col("us") + F.col("x.late")
    return out.select((F.col("seq") * 5 + F.col("x.variant")).alias("seq"), "user_id", us.alias("us"), F.col("x.u").alias("url"), "title")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, user_id, us, query, engine: sign-ups, with the text of the benchmark item that their number falls on."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    keyed = events.withColumn("item_id", F.col("event_id") % F.lit(max(1, items.count())))
    return keyed.join(items, "item_id").select(F.col("event_id").alias("seq"), "user_id", micros().alias("us"), "query", F.lit("google.com").alias("engine"))


#: Of the first conversation; one conversation an hour, one turn in five minutes.
EPOCH_US = 1704067200000000


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us, prompt, conversation, project: the users' turns."""
    us = F.lit(EPOCH_US) + F.col("conv_id") * 3_600_000_000 + F.col("turn") * 300_000_000
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), us.alias("us"), F.col("text").alias("prompt"), F.col("conv_id").alias("conversation"), F.concat(F.lit("project"), F.col("conv_id") % 7).alias("project"))


#: Prefixes of the made-up commit messages, by event number.
PREFIXES = ("feat(api): add ", "fix: resolve crash in ", "docs: readme of ", "wip", "refactor(core)!: simplify ", "update because of ", "perf: cache ", "tweak ", "revert: undo ", "rename ")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, user_id, us, repo, message, insertions, deletions: purchases, with the part that their number falls on."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    n = parts.agg(F.count("*").alias("n"), F.min("p_partkey").alias("lo")).first()
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    keyed = events.withColumn("p_partkey", F.col("event_id") % F.lit(max(1, n["n"])) + F.lit(n["lo"] or 0))
    prefix = F.get(F.array(*map(F.lit, PREFIXES)), (F.col("event_id") % len(PREFIXES)).cast("int"))
    message = F.when(prefix == "wip", prefix).otherwise(F.concat(prefix, F.lower("p_type")))
    return keyed.join(parts, "p_partkey").select(F.col("event_id").alias("seq"), "user_id", micros().alias("us"), F.col("p_brand").alias("repo"), message.alias("message"), F.floor("value").cast("long").alias("insertions"), F.floor(F.col("value") / 7).cast("long").alias("deletions"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us, hour, activity_type, topics, entities: the events, with topics and entities read off their numbers."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    topic = lambda n: F.concat(F.lit("topic"), (n % 9).cast("string"))
    entity = lambda n: F.concat(F.lit("Tool"), (n % 13).cast("string"))
    return e.select(F.col("event_id").alias("seq"), "user_id", micros().alias("us"), F.hour("ts").alias("hour"), F.to_date("ts").alias("day"), F.col("event_type").alias("activity_type"),
                    F.array_distinct(F.array(topic(k), topic(F.col("event_id")))).alias("topics"), F.array_distinct(F.array(entity(k), entity(F.col("event_id") % 31), entity(F.col("user_id")))).alias("entities"))
