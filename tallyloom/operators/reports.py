"""Rollups, budgets, tiers, costs and small text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from . import joins


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def two_levels(df: DataFrame, outer: str, inner: str, top: int) -> DataFrame:
    """outer, inner, n, total of the outer group, for the top inner values of each outer one."""
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    totals = counts.groupBy(outer).agg(F.sum("n").alias("total"))
    order = Window.partitionBy(outer).orderBy(F.desc("n"), inner)
    return counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n").join(totals, outer)


def budget_shares(counts: DataFrame, budget: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, source, n, share: a floor for each active source, the rest in proportion."""
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    active = F.count_if(F.col("n") > 0).over(whole)
    floor = F.least(F.floor(F.lit(budget) * 0.1), F.floor(F.lit(budget) / active))
    share = floor + F.floor((F.lit(budget) - active * floor) * F.col("n") / F.sum("n").over(whole) + 0.5)
    return counts.withColumn("share", F.when(F.col("n") > 0, share).otherwise(0).cast("long"))


def cost_rollup(costs: DataFrame) -> DataFrame:
    """Totals over everything and by provider, persona and tier, by grouping sets."""
    costs.createOrReplaceTempView("_costs")
    return costs.sparkSession.sql("""
        SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(persona) = 0 THEN 'persona' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS level,
               coalesce(provider, persona, tier, '') AS name, count(*) AS n, sum(input_tokens) AS input_tokens, round(sum(cost), 4) AS cost,
               round(sum(cost) * 7, 3) AS week, round(sum(cost) * 30, 3) AS month
        FROM _costs GROUP BY GROUPING SETS ((), (provider), (persona), (tier))""")


def weighted_score(df: DataFrame, key: str, parts: dict[str, float]) -> DataFrame:
    """key, score: the mean of the parts that are there, by weight."""
    have = {c: F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()}
    top = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    return df.groupBy(key).agg(F.avg(top / sum(have.values(), F.lit(0.0))).alias("score"))


def numbered_ids(df: DataFrame, column: str, order: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The first of equal ids of a key stays, the next become id_2, id_3."""
    n = F.row_number().over(Window.partitionBy(*keys, column).orderBy(*order))
    return df.withColumn("unique_id", F.when(n == 1, F.col(column)).otherwise(F.concat_ws("_", column, n.cast("string"))))


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """batch (from 0) of so many rows in each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(n / size).cast("long"))


#: What each privacy tier may see: columns of events.
TIERS = {1: ("source", "category", "summary", "topics", "entities", "text"), 2: ("source", "category", "summary", "topics", "entities"), 3: ("category", "topics", "activity_type"), 4: ("activity_type",)}


def tier_view(events: DataFrame, tier: int) -> DataFrame:
    return events.select(*[c for c in TIERS[tier] if c in events.columns])


def fit_text(full: Column, condensed: Column, stats: Column, tokens: Column) -> Column:
    """The longest of three forms that fits, the shortest if none does."""
    return F.when(words.token_estimate(full) <= tokens, full).when(words.token_estimate(condensed) <= tokens, condensed).otherwise(stats)


def upsert_new(existing: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What is there, and what is new."""
    return existing.unionByName(found.dropDuplicates(keys).join(existing, keys, "left_anti"))


def merge_fields(generated: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """Generated fields with the values that a user has saved for them, and saved fields that are no longer generated."""
    g, s = generated.withColumnRenamed(value, "_g"), saved.withColumnRenamed(value, "_s")
    return g.join(s, key, "full").select(key, F.coalesce("_s", "_g").alias(value))


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a markdown table; a larger one is refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{title}: more than {most} rows are no small result")
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(str(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in got])


def compressed(events: DataFrame, budget: int) -> DataFrame:
    """source, level, body of events (source, part, line), each source within its share of the budget in tokens: all lines, else its parts with their counts, else its count alone.

    What a form would cost is summed first, so only lines that fit the budget are ever gathered."""
    cost = lambda c: F.ceil((F.sum(F.length(c) + 1) - 1) / 4)
    lines = events.groupBy("source").agg(F.count("*").alias("n"), cost("line").alias("full"))
    parts = events.groupBy("source", "part").agg(F.count("*").alias("k")).withColumn("line", F.concat("part", F.lit(": "), F.col("k").cast("string")))
    level = F.when(F.col("full") <= F.col("share"), "full").when(F.col("grouped") <= F.col("share"), "grouped").otherwise("count")
    plan = budget_shares(lines, budget).join(parts.groupBy("source").agg(cost("line").alias("grouped")), "source").withColumn("level", level).select("source", "n", "level")
    chosen = events.select("source", "line", F.lit("full").alias("level")).unionByName(parts.select("source", "line", F.lit("grouped").alias("level"))).join(joins.sized(plan), ["source", "level"])
    body = chosen.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    return plan.join(body, "source", "left").select("source", "level", F.coalesce("body", F.concat(F.col("n").cast("string"), F.lit(" events"))).alias("body"))


def decisions(current: DataFrame, previous: DataFrame, local: str, least: dict[str, float], otherwise: float = 0.75, gain: float = 0.10, loss: float = 0.05) -> DataFrame:
    """name, regression, meets, choice of results (name, quality) against an earlier run: baseline without one, block-merge if more than `loss` of the quality is gone, else approve;
    whether the quality reaches the name's least; and whether the local result of that name suffices because the quality gained over it is not above `gain`."""
    before = previous.select("name", F.col("quality").alias("_before"))
    here = current.where(F.col("name") == local).agg(F.max("quality")).first()[0]
    rows = current.join(before, "name", "left")
    needed = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in least.items()], F.lit(otherwise))
    regression = F.when(F.col("_before").isNull(), "baseline").when(F.col("quality") < F.col("_before") * (1 - loss), "block-merge").otherwise("approve")
    choice = F.when(F.col("quality") - F.lit(here) > gain, "recommended").otherwise("local-sufficient")
    return rows.select("name", regression.alias("regression"), (F.col("quality") >= needed).alias("meets"), choice.alias("choice"))
