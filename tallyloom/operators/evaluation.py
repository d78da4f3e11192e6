"""Outputs of providers scored, priced and held against a baseline, and rules checked over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import sized

# Dollars for a million tokens in and out, and the providers that cost nothing.
PRICE_IN, PRICE_OUT, FREE = 0.8, 0.4, ("mock", "local")

# Part of a persona's name, the least focus that counts by half, the least and the greatest that counts in full. The first match holds; the empty part matches all.
# A name with "unfocused" has "focused" in it, so it goes by that range.
FOCUS = (("focused", 0.60, 0.75, None), ("productive", 0.65, 0.75, None), ("", 0.35, 0.50, 0.90))


def steps(value: Column, *bands: tuple[float, int]) -> Column:
    """The points of the first bound that the value reaches, 0 if none."""
    return F.coalesce(*[F.when(value >= least, F.lit(points)) for least, points in bands], F.lit(0))


def focus_points(focus: Column, persona: Column) -> Column:
    full = lambda low, high: (focus >= low) & (focus <= high if high is not None else F.lit(True))
    points = lambda half, low, high: F.when(full(low, high), 20).when(focus >= half, 10).otherwise(0)
    return F.coalesce(*[F.when(F.lower(persona).contains(part), points(*band)) for part, *band in FOCUS], points(*FOCUS[-1][1:]))


def quality_points(headline: Column, patterns: Column, connections: Column, focus: Column, persona: Column) -> Column:
    """0 to 100: half for any output, the rest for a headline of a fit length, for patterns, connections and a focus that suits the persona. A null part earns nothing."""
    size = F.length(headline)
    parts = F.when(size.between(20, 150), 20).when(size.between(10, 19), 10).otherwise(0) + steps(patterns, (2, 30), (1, 15)) + steps(connections, (2, 20), (1, 10)) + focus_points(focus, persona)
    return F.least(F.lit(100), 50 + parts)


def drift(now: Column, base: Column, much: int, some: int, new: int) -> Column:
    """Points lost where a count is over half, or over a twentieth, away from the baseline's, or appears where that has none."""
    away = F.abs(now / base - 1)
    return F.when(base > 0, F.when(away > 0.5, much).when(away > 0.05, some).otherwise(0)).when(now > 0, new).otherwise(0)


def compare_providers(results: DataFrame, baseline: str = "mock") -> DataFrame:
    """provider, persona, n, cost, quality, consistency, and the deltas of cost and quality against the baseline's results for the persona.

    results: provider, persona, headline, patterns, connections, focus, tokens_in, tokens_out, one row for each output. The baseline of a persona is the mean of the baseline provider's
    outputs; without one, consistency and deltas are null. Consistency is the mean over outputs of 1 less what drift in patterns, focus and connections costs. Nulls count as 0 (a null persona as ''), repeated
    rows count each. Points are whole numbers and focus is summed to six digits, so that results do not depend on the order of rows; baselines, one row a persona, are broadcast if their count is small."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = results.select("provider", F.coalesce("persona", F.lit("")).alias("persona"), *[number(c).alias(c) for c in ("patterns", "connections", "tokens_in", "tokens_out")], number("focus").cast("double").alias("focus"),
                          quality_points(F.col("headline"), F.col("patterns"), F.col("connections"), F.col("focus"), F.col("persona")).alias("q"))
    rate = F.when(F.col("provider").isin(*FREE), 0).otherwise(1)
    cost = (F.sum("tokens_in") * F.lit(PRICE_IN) + F.sum("tokens_out") * F.lit(PRICE_OUT)) / 1_000_000
    mean = lambda c: F.sum(c).cast("double") / F.count("*")
    base = rows.where(F.col("provider") == baseline).groupBy("persona").agg(mean("patterns").alias("_patterns"), mean("connections").alias("_connections"), mean(F.col("focus").cast("decimal(9,6)")).alias("_focus"))
    joined = rows.join(sized(base), "persona", "left")
    far = F.abs(F.col("focus") - F.col("_focus"))
    lost = drift(F.col("patterns"), F.col("_patterns"), 30, 10, 5) + F.when(far > 0.2, 20).when(far > 0.1, 10).otherwise(0) + drift(F.col("connections"), F.col("_connections"), 20, 5, 2)
    steady = F.when(F.col("_focus").isNotNull(), F.greatest(F.lit(0), 100 - lost))
    each = joined.groupBy("provider", "persona").agg(F.count("*").alias("n"), (F.first(rate) * cost).alias("cost"), (mean("q") / 100).alias("quality"), (mean(steady) / 100).alias("consistency"))
    own = each.where(F.col("provider") == baseline).select("persona", F.col("cost").alias("_cost"), F.col("quality").alias("_quality"))
    return each.join(sized(own), "persona", "left").select("provider", "persona", "n", "cost", "quality", "consistency", (F.col("cost") - F.col("_cost")).alias("cost_delta"), (F.col("quality") - F.col("_quality")).alias("quality_delta"))


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, rule, checked, failed, passed: for each rule, a condition that rows are to meet, how many of the rows do not (null: not met). All rules are counted in one scan and one aggregate;
    without keys, an empty table passes every rule."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("checked"), *[F.count_if(~F.coalesce(met, F.lit(False))).alias(f"_{k}") for k, met in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{k}").alias("failed")) for k, name in enumerate(rules)])
    return counted.select(*keys, "checked", F.inline(each)).select(*keys, "rule", "checked", "failed", (F.col("failed") == 0).alias("passed"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def output_rules(text: Column, size: Column, least: int, leaks: Column, score: Column) -> dict[str, Column]:
    """What an output must meet: a text that is there, as long as stated, of a least size, not cut off, without secrets, with a score of 0 to 1."""
    return {
        "present": F.length(F.trim(text)) > 0,
        "stated size": F.length(text) == size,
        "least size": F.length(text) >= least,
        "whole": ~all_of(F.length(text) > 0, F.rtrim(text).rlike("(\\.\\.\\.|…)$")),
        "no secrets": leaks == 0,
        "score in range": score.between(0, 1),
    }
