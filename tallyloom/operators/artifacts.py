"""Artifacts of a vault as a keyed table: notes of topics, entities and seeds, and weekly maps, each with the days that link to it.

An artifact is a row (kind, slug, title, created, links), links a sorted array of (day, extra) structs, one for each day. A merge unites the links of equal keys, so merging the same days twice changes
nothing and days may come in any order; of equal days the entry that was there first stays. Seeds are made once and never linked again. Mentions are combined by key and day before they
are gathered: an artifact has one link for each day, not for each mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, slug string, title string, created date, links array<struct<day: date, extra: string>>"
KEYS = ["kind", "slug"]


def iso_week(day: Column) -> Column:
    """Such as 2024-W05: the year is that of the week's Thursday."""
    thursday = F.date_add(day, 3 - F.weekday(day))
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def of_mentions(mentions: DataFrame, slug: Column, kind: str) -> DataFrame:
    """Artifacts of one kind of mentions (name, day): the title is the first name of the slug by day."""
    rows = mentions.where("name is not null and day is not null").withColumn("slug", slug).where("slug <> ''")
    days = rows.groupBy("slug", "day").agg(F.min("name").alias("name"))
    link = F.struct("day", F.lit(None).cast("string").alias("extra"))
    out = days.groupBy("slug").agg(F.min_by("name", F.struct("day", "name")).alias("title"), F.min("day").alias("created"), F.sort_array(F.collect_list(link)).alias("links"))
    return out.select(F.lit(kind).alias("kind"), "slug", "title", "created", F.slice("links", 1, 1).alias("links") if kind == "seed" else "links")


def weekly_maps(days: DataFrame, most: int = 10) -> DataFrame:
    """A map for each ISO week of days (day, topics: slugs in order): each day is linked with its first few topics."""
    extra = F.array_join(F.transform(F.slice("topics", 1, most), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    rows = days.select(iso_week(F.col("day")).alias("slug"), "day", F.nullif(extra, F.lit("")).alias("extra"))
    once = rows.groupBy("slug", "day").agg(F.min("extra").alias("extra"))
    out = once.groupBy("slug").agg(F.min("day").alias("created"), F.sort_array(F.collect_list(F.struct("day", "extra"))).alias("links"))
    return out.select(F.lit("week").alias("kind"), "slug", F.concat(F.lit("Week "), "slug").alias("title"), "created", "links")


def merged(existing: DataFrame, found: DataFrame) -> DataFrame:
    """The artifacts with their links united; both tables have each key once."""
    both = existing.select(*KEYS, F.struct("title", "created", "links").alias("_a")).join(found.select(*KEYS, F.struct("title", "created", "links").alias("_b")), KEYS, "full")
    none = F.array().cast("array<struct<day: date, extra: string>>")
    old, new = F.coalesce("_a.links", none), F.coalesce("_b.links", none)
    had = F.transform(old, lambda x: x.day)
    links = F.sort_array(F.concat(old, F.filter(new, lambda x: ~F.array_contains(had, x.day))))
    links = F.when((F.col("kind") == "seed") & F.col("_a").isNotNull(), F.col("_a.links")).otherwise(links)
    return both.select(*KEYS, F.coalesce("_a.title", "_b.title").alias("title"), F.coalesce("_a.created", "_b.created").alias("created"), links.alias("links"))


def rendered(artifacts: DataFrame, daily: str = "daily") -> DataFrame:
    """path, text of the notes: front matter, title and a line for each link."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    link = lambda x: F.concat(F.lit(f"[[{daily}/"), day(x), F.lit("]]"))
    line = lambda x: F.concat(F.lit("- "), link(x.day), F.lit(" — "), day(x.day), F.coalesce(F.concat(F.lit(" · Topics: "), x.extra), F.lit("")))
    week = F.col("kind") == "week"
    front = F.concat(F.lit("---\ntype: "), F.when(week, "moc").otherwise(F.col("kind")), F.when(week, F.concat(F.lit("\nweek: "), "slug")).otherwise(""), F.lit("\ncreated: "), day(F.col("created")))
    seeded = F.concat(F.lit('\nsource: "'), link(F.col("created")), F.lit('"\nstatus: stub'))
    head = F.concat(front, F.when(F.col("kind") == "seed", seeded).otherwise(""), F.lit("\n---\n\n# "), "title", F.lit("\n\n"))
    listed = F.concat(F.when(week, "## Daily Notes\n\n").otherwise("## Appearances\n\n"), F.array_join(F.transform("links", line), "\n"), F.lit("\n"))
    stub = F.concat(F.lit("> Seeded from "), link(F.col("created")), F.lit(" on "), day(F.col("created")), F.lit(". Expand this note.\n\n## Notes\n\n"))
    return artifacts.select(F.concat_ws("/", F.concat("kind", F.lit("s")), F.concat("slug", F.lit(".md"))).alias("path"), F.concat(head, F.when(F.col("kind") == "seed", stub).otherwise(listed)).alias("text"))
