"""The day's stages end to end, the collector and the sinks."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.config import EngineConfig
from tallyloom.operators import classify, state
from tallyloom.plans.engine import Engine
from tallyloom.plans.q_sets import rules_dim, sensitive_dim
from tallyloom.sources import collect, driver_tables, sinks

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_stage(spark):
    d = str(DATA)
    day = F.lit("2024-01-10").cast("date")
    config = EngineConfig(sensitive_categories=("health",), min_cluster_size=2)
    e = Engine(driver_tables.visits(spark, d), driver_tables.searches(spark, d), driver_tables.prompts(spark, d), driver_tables.commits(spark, d), rules_dim(spark), sensitive_dim(spark), None, day, config)
    for name in Engine.STAGES:
        assert e.stage(name).columns, name
    assert e.filtered.count() < e.visits.count() and e.classified.count() == e.filtered.count() + e.searches.count() + e.prompts.count() + e.commits.count()
    assert e.for_model().columns == ["activity_type"] and 0.3 <= e.focus.first()["score"] <= 0.98
    assert e.note().startswith("## Focus") and {"label", "topics", "entities"} <= set(e.temporal.columns) and {"label", "why", "work_mode"} <= set(e.units.columns) and e.missions.agg(F.sum("queries")).first()[0] == e.searches.count()
    with pytest.raises(ValueError):
        e.stage("nothing")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_users_and_days_are_kept_apart(spark):
    """With another user's rows beside them, and another day's, a user's day gives the same results."""
    d = str(DATA)
    user = F.lit(7).cast("long").alias("user_id")
    inputs = [driver_tables.visits(spark, d), driver_tables.searches(spark, d), driver_tables.prompts(spark, d), driver_tables.commits(spark, d)]
    one = [df.select(*[c for c in df.columns if c != "user_id"], user) for df in inputs]
    day, config = F.lit("2024-01-10").cast("date"), EngineConfig(min_cluster_size=2, cooccurrence_minutes=600, mission_minutes=3000, cluster_gap_minutes=600, engagement_threshold=0.2, link_minutes=300)
    other = [df.where("seq % 3 <> 0").withColumns({"user_id": F.lit(8).cast("long"), "seq": F.col("seq") + 10_000_000, "us": F.col("us") + 60_000_000}) for df in one]
    later = [df.where("seq % 2 = 0").withColumns({"seq": F.col("seq") + 20_000_000, "us": F.col("us") + 400 * 86_400_000_000}) for df in one]
    alone = Engine(*one, rules_dim(spark), None, None, day, config)
    mixed = Engine(*[a.unionByName(b).unionByName(c) for a, b, c in zip(one, other, later, strict=True)], rules_dim(spark), None, None, day, config)
    last = 20_000
    for name in ("temporal", "pairs", "focus", "missions", "clusters", "units", "linked"):
        mine = lambda df: df.where(f"cluster LIKE '7-%' AND CAST(split(cluster, '-')[1] AS LONG) < {last}") if "cluster" in df.columns else df.where("user_id = 7")
        today = lambda df: df.where(f"day < {last}") if "day" in df.columns else df
        if name in ("pairs", "units", "linked"):  # the later days belong to the same user: compare with another user alone beside
            both = Engine(*[a.unionByName(b) for a, b in zip(one, other, strict=True)], rules_dim(spark), None, None, day, config)
        else:
            both = mixed
        got, want = (sorted(map(str, today(mine(e.stage(name))).collect())) for e in (both, alone))
        assert got == want and want, name


def test_collector(spark):
    rows = [
        (1, 10, "https://www.google.com/search?q=spark+joins", "spark joins - Google Search"), (2, 20, "https://www.google.com/url?q=https%3A%2F%2Fa.com%2Fx", "r"), (3, 30, "https://a.com/x?z=1", "A page about x"),
        (4, 40, "chrome://newtab", "New Tab"), (5, 50, "http://localhost:8080/", "dev"), (6, 60, "https://b.com/", "B site title"), (7, 70, "https://bing.com/search?q=spark+joins", "x"), (8, 5, "https://c.com", "too early"),
    ]
    visits, searches = collect.collect(spark.createDataFrame(rows, "seq long, us long, url string, title string"), EngineConfig(), 10, 1000)
    assert sorted(r["seq"] for r in visits.collect()) == [3, 6]
    assert [(r["query"], r["engine"]) for r in searches.collect()] == [("spark joins", "bing.com")]


def test_decoded_answers(spark):
    df = spark.createDataFrame([('{"activityType":"learning","confidence":7,"topics":["a","b","c","d"],"intent":"x"}',), ("no json",)], "a string")
    got = [r["v"] for r in df.select(classify.decode(F.col("a")).alias("v")).collect()]
    assert (got[0]["activity_type"], got[0]["confidence"], len(got[0]["topics"]), got[0]["intent"]) == ("learning", 1.0, 3, "explore") and got[1] is None


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.read_state(spark, path).count() == 0
    for n in (1, 2):
        day = F.lit(f"2025-01-0{n}").cast("date")
        sinks.write_state(state.update(sinks.read_state(spark, path), spark.createDataFrame([("a",)], "topic string"), day), path, n)
    assert [(r["topic"], r["day_count"]) for r in sinks.read_state(spark, path).collect()] == [("a", 2)]
    sinks.write_report(sinks.read_state(spark, path).select("topic", "day_count"), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["topic"] == "a"


def test_merged_notes():
    old = "## Focus\nold\n## Notes\nmine\n## Own\nkept\nmood:: fine\n"
    assert sinks.merge_note("## Focus\nnew\nmood::\n## Notes\n", old) == "## Focus\nnew\nmood:: fine\n## Notes\nmine\n## Own\nkept\nmood:: fine\n"
    assert sinks.merge_note("x", None) == "x"
