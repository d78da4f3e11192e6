from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import containment, engagement, joins, patterns


def made_up(seed):
    rng = random.Random(seed)
    letters = "abcaab éü\U0001f600." if seed % 2 else "ab"
    word = lambda n: "".join(rng.choices(letters, k=rng.randrange(n)))
    return [word(60) for _ in range(150)] + [None, "", "aaaaaaaaa" * 3000], [word(12) for _ in range(120)] + [None, "", "aaaaaaaaaaaaaaaaaaaaaa", "absent pattern"]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_every_pair(spark, seed):
    texts, found = made_up(seed)
    x = spark.createDataFrame([(t, 1) for t in texts + texts[:5]], "text string, gram int")
    p = spark.createDataFrame([(q,) for q in found + found[:5]], "pattern string")
    got = sorted(map(tuple, containment.contained(x, p).collect()))
    assert got == sorted({(t, q) for t in texts for q in found if t is not None and q is not None and q in t})
    rest = containment.without(x, F.col("text"), p.where("pattern <> ''")).select("text").collect()
    assert sorted(str(r[0]) for r in rest) == sorted(str(t) for t in texts + texts[:5] if t is None or not any(q in t for q in found if q))
    assert containment.contained(x.where("false"), p).collect() == [] and containment.contained(x, p.where("false")).collect() == []
    assert containment.without(x, F.col("text"), p.where("false")).count() == len(texts) + 5


def test_both_ways(spark):
    names = ["docs", "m", "example.org", "mail.example.com", "zz", "q", None]
    known = ["example.com", "docs.site.net", "zzz"]
    got = joins.not_covered(spark.createDataFrame([(n,) for n in names], "domain string"), spark.createDataFrame([(k,) for k in known], "pattern string")).collect()
    assert {r[0] for r in got} == {n for n in names if n is None or not any(k in n or n in k for k in known)}


def test_many_patterns_and_no_nested_loop(spark):
    many = spark.range(30_000).select(F.concat(F.lit("host"), "id", F.lit(".net")).alias("pattern"), F.lit("adult").alias("category"))
    searches = spark.createDataFrame([(1, "see HOST17.net now"), (2, "see host30001.net"), (3, "ghost29999.network"), (4, None)], "seq long, query string")
    left = engagement.drop_sensitive_searches(searches, many)
    assert {r["seq"] for r in left.collect()} == {2, 4}
    names = spark.createDataFrame([("Host5.net",), ("nowhere",)], "entity string")
    new = patterns.novel_entities(names, many.select(F.col("pattern").alias("topic")))
    assert [r["entity"] for r in new.collect()] == ["nowhere"]
    for df in (left, new, joins.not_covered(searches.select(F.col("query").alias("domain")), many)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grams_come_from_whole_texts_at_a_time(spark, monkeypatch):
    """No expression cuts a text run by run; texts that end in a batch's middle, in several bytes a character, are told apart."""
    texts = ["ab", "éa", "", "cdefghijk", "x" * 50 + "tail of it", None, "äöü"]
    x, p = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([("bé",), ("é",), ("tail of it",), ("öü",), ("acde",), ("xt",)], "pattern string")
    monkeypatch.setattr(containment, "TOGETHER", 12)
    found = containment.contained(x.coalesce(1), p)
    assert {(r["text"][-10:], r["pattern"]) for r in found.collect()} == {("éa", "é"), ("tail of it", "tail of it"), ("tail of it", "xt"), ("äöü", "öü")}
    plan = found._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan
    assert containment.contained(x, p.where("pattern = 'acde'")).collect() == []
