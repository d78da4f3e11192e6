"""Provider comparison and rules on small cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evaluation

RESULT = "provider string, persona string, headline string, patterns long, connections long, focus double, tokens_in long, tokens_out long"


def test_providers_against_a_baseline(spark):
    rows = [
        ("mock", "focused", "h" * 30, 2, 2, 0.8, 100, 100),
        ("mock", None, None, None, None, None, None, None),  # only the base of 50 points
        ("hosted", "focused", "h" * 12, 1, 0, 0.65, 1_000_000, 500_000),  # 10 + 15 + 0 + 10
        ("hosted", "unfocused", "h" * 9, 0, 1, 0.5, 0, 0),  # "focused" by its name: no points for 0.5
        ("hosted", "other", "h" * 151, 0, 0, 0.95, 0, 0),
    ]
    df = spark.createDataFrame(rows, RESULT)
    got = {(r["provider"], r["persona"]): r for r in evaluation.compare_providers(df).collect()}
    assert {k: round(r["quality"], 6) for k, r in got.items()} == {("mock", "focused"): 1.0, ("mock", ""): 0.5, ("hosted", "focused"): 0.85, ("hosted", "unfocused"): 0.6, ("hosted", "other"): 0.6}
    hosted = got["hosted", "focused"]
    assert (hosted["cost"], hosted["cost_delta"]) == (pytest.approx(1.0), pytest.approx(1.0)) and hosted["quality_delta"] == pytest.approx(-0.15)
    assert hosted["consistency"] == pytest.approx(0.6)  # patterns half of the baseline's: 10; focus 0.15 away: 10; no connections: 20
    assert got["mock", "focused"]["consistency"] == 1.0 and got["hosted", "other"]["consistency"] is None
    assert evaluation.compare_providers(df.where("false")).count() == 0


def test_all_rules_in_one_aggregate(spark):
    texts = [("a", "whole text", 10), ("a", "cut off...", 10), ("a", None, 0), ("b", "  ", 3)]
    df = spark.createDataFrame(texts, "k string, text string, size long")
    rules = evaluation.output_rules(F.col("text"), F.col("size"), 5, F.lit(0), F.lit(0.5))
    got = {(r["k"], r["rule"]): (r["checked"], r["failed"], r["passed"]) for r in evaluation.violations(df, rules, ["k"]).collect()}
    assert got["a", "present"] == (3, 1, False) and got["a", "stated size"] == (3, 1, False) and got["a", "whole"] == (3, 2, False) and got["a", "no secrets"] == (3, 0, True)
    assert got["b", "present"] == (1, 1, False) and got["b", "stated size"] == (1, 1, False) and got["b", "score in range"] == (1, 0, True)
    empty = evaluation.violations(df.where("false"), rules).collect()
    assert len(empty) == 6 and all(r["passed"] and r["checked"] == 0 for r in empty)
    plan = evaluation.violations(df, rules, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
