"""Boundaries, ties and invariants of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import classify, clusters, dedup, engagement, joins, patterns, reports, state, temporal

MIN = 60_000_000


def visits(spark, rows):
    return spark.createDataFrame(rows, "seq long, us long, url string, title string")


def test_map_viewports_are_one_page(spark):
    rows = [(i, i * MIN, f"https://www.google.com/maps/dir/A/B/@32.{i},-84.9,12z", "Way to B") for i in range(81)]
    out = dedup.dedup_visits(visits(spark, rows), 5).collect()
    assert [(r["seq"], r["copies"]) for r in out] == [(0, 81)]


def test_domain_cap_and_idempotence(spark):
    rows = [(i, i * MIN, f"https://a.com/{i}", "Some title") for i in range(10)]
    once = dedup.dedup_visits(visits(spark, rows), 5)
    assert sorted(r["seq"] for r in once.collect()) == [5, 6, 7, 8, 9]
    assert sorted(r["seq"] for r in dedup.dedup_visits(once.drop("copies", "domain"), 5).collect()) == [5, 6, 7, 8, 9]
    shuffled = visits(spark, rows[::-1]).repartition(3)
    assert sorted(r["seq"] for r in dedup.dedup_visits(shuffled, 5).collect()) == [5, 6, 7, 8, 9]


def test_best_title_then_earliest(spark):
    rows = [(1, 5 * MIN, "https://a.com/x", "Home"), (2, 4 * MIN, "https://a.com/x?q", "A long title here"), (3, 3 * MIN, "https://www.a.com/x/", "A long title here"), (4, None, "https://a.com/x", "A long title here")]
    assert [r["seq"] for r in dedup.dedup_visits(visits(spark, rows), 5).collect()] == [3]


def test_gap_sessions(spark):
    t = [0, 90 * MIN, 181 * MIN, 23 * 60 * MIN, 24 * 60 * MIN]
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate(t)], "seq long, us long, repo string")
    assert [r["session"] for r in temporal.gap_sessions(df, ["repo"], 90).orderBy("seq").collect()] == [1, 1, 2, 3, 4]
    assert [r["session"] for r in temporal.gap_sessions(df, ["repo"], 90, by_day=False).orderBy("seq").collect()] == [1, 1, 2, 3, 3]


def test_search_window_is_inclusive(spark):
    s = spark.createDataFrame([(1, 0), (2, 10 * MIN)], "seq long, us long")
    v = spark.createDataFrame([(1, 0), (2, 5 * MIN), (3, 5 * MIN + 1), (4, -1)], "seq long, us long")
    got = {r["seq"]: (r["n_visits"], r["intent_type"]) for r in joins.link_searches(s, v, 5, []).collect()}
    assert got == {1: (2, "directed"), 2: (0, "directed")}


def test_anchored_windows(spark):
    df = spark.createDataFrame([(i, m * MIN, 1) for i, m in enumerate((0, 20, 30, 31, 61, 62))], "seq long, us long, k int")
    assert [r["window"] for r in temporal.anchored_windows(df, ["k"], 30).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]


def test_missions(spark):
    df = spark.createDataFrame([(1, 0, ["a", "b"], 1), (2, MIN, ["b", "c"], 1), (3, 2 * MIN, ["c"], 1), (4, 13 * MIN, ["c"], 1)], "seq long, us long, content array<string>, k int")
    assert [r["mission"] for r in temporal.search_missions(df, ["k"], 10).orderBy("seq").collect()] == [0, 0, 1, 2]


def test_hour_islands(spark):
    df = spark.createDataFrame([(1, 10, "dev"), (2, 10, "dev"), (3, 11, "dev"), (4, 11, "dev"), (5, 13, "dev"), (6, 13, "news"), (7, 13, "news")], "seq long, hour int, activity_type string").withColumn("day", F.lit(1))
    got = sorted((r["activity_type"], r["hour_start"], r["hour_end"], r["event_count"]) for r in temporal.hour_islands(df, ["day"]).collect())
    assert got == [("dev", 10, 11, 4), ("news", 13, 13, 3)]


def test_focus(spark):
    one = spark.createDataFrame([(1, ["a"], "dev")] * 4, "k int, topics array<string>, activity_type string")
    r = patterns.focus_score(one, ["k"]).first()
    assert r["score"] >= 0.95 and r["label"] == "Highly focused"
    many = spark.createDataFrame([(1, [f"t{i}"], f"a{i}") for i in range(8)], one.schema)
    assert 0.30 <= patterns.focus_score(many, ["k"]).first()["score"] < 0.45


def test_entity_relations(spark):
    rows = [(["A", "B"], "dev")] * 3 + [(["A", "C"], "dev")] * 2 + [(["B", "C"], "unknown")] * 4
    got = patterns.entity_relations(spark.createDataFrame(rows, "entities array<string>, activity_type string")).collect()
    assert [(r["a"], r["b"], r["n"]) for r in got] == [("A", "B", 3)]


def test_recurrence_and_state_over_days(spark):
    h = state.empty_history(spark)
    day = lambda n: F.date_add(F.lit("2025-06-01").cast("date"), n)
    seen = {0: ["a"], 1: ["a", "B"], 2: ["a"], 3: ["a"], 4: ["a"], 12: ["b", "a"], 45: ["a"]}
    trends = {}
    for n, names in seen.items():
        today = spark.createDataFrame([(x,) for x in names], "topic string")
        trends[n] = {r["topic"]: r["trend"] for r in state.recurrence(today, h, day(n)).collect()}
        h = spark.createDataFrame(state.update(state.update(h, today, day(n)), today, day(n)).collect(), h.schema)
    assert trends[0] == {"a": "new"} and trends[3] == {"a": "rising"} and trends[12] == {"a": "returning", "b": "returning"} and trends[2] == {"a": "declining"}
    rows = {r["topic"]: r for r in h.collect()}
    assert rows["a"]["day_count"] == 7 and len(rows["a"]["recent_days"]) == 1 and str(rows["a"]["first_seen"]) == "2025-06-01" and rows["b"]["day_count"] == 2


def test_greedy_clusters(spark):
    a, b = ["alpha", "beta", "gamma"], ["delta", "eps"]
    rows = [(1, 0, a), (2, 5 * MIN, a), (3, 6 * MIN, b), (4, 66 * MIN, a)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "seq long, us long, terms array<string>, k int")
    assert [r["cluster"] for r in clusters.greedy(df, ["k"], 45, 0.3).orderBy("seq").collect()] == [0, 0, 1, 2]


def plain_greedy(rows, gap, similarity):
    """Every cluster is looked at, with its whole vector."""
    import math

    docs = [list(t) for _, _, t in rows]
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    found, out = [], []
    for _, us, d in rows:
        kinds = sorted(set(d))
        v = {t: d.count(t) / len(kinds) * (1 + math.log(len(docs) / df[t])) for t in kinds}
        size = math.sqrt(sum(x * x for x in v.values()))
        for i, (total, last) in enumerate(found):
            norm = size * math.sqrt(sum(x * x for x in total.values()))
            if us - last <= gap and norm and sum(x * total.get(t, 0.0) for t, x in v.items()) / norm >= similarity:
                break
        else:
            i = len(found)
            found.append(({}, us))
        total = found[i][0]
        for t, x in v.items():
            total[t] = total.get(t, 0.0) + x
        found[i] = (total, us)
        out.append(i)
    return out


def test_many_small_groups_are_folded_in_one_call(spark):
    """One task walks all its groups, across batches; a call for each group would show in the plan."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(u, i, i * MIN, ["alpha", "beta"] if i % 3 else ["gamma"], ["a"] if i % 4 else ["b"]) for u in range(60) for i in range(u % 9 + 1)]
    df = spark.createDataFrame(rows, "k int, seq long, us long, terms array<string>, content array<string>")
    found, missions = clusters.greedy(df, ["k"], 45, 0.3), temporal.search_missions(df, ["k"], 30)
    got, chains = {(r["k"], r["seq"]): r["cluster"] for r in found.collect()}, {(r["k"], r["seq"]): r["mission"] for r in missions.collect()}
    for u in range(60):
        mine = [r for r in rows if r[0] == u]
        assert [got[u, r[1]] for r in mine] == plain_greedy([(r[1], r[2], r[3]) for r in mine], 45 * MIN, 0.3)
        n, opener = -1, None
        for r in mine:
            if opener != r[4]:
                n, opener = n + 1, r[4]
            assert chains[u, r[1]] == n
    assert all("MapInArrow" in df._jdf.queryExecution().toString() and "FlatMapGroups" not in df._jdf.queryExecution().toString() for df in (found,))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_clusters_are_those_of_the_plain_search(spark, seed):
    import random

    rng = random.Random(seed)
    rows = sorted((i, rng.randrange(600) * MIN, [rng.choice("abcdefghij") * 3 for _ in range(rng.randrange(5))]) for i in range(300))
    rows.sort(key=lambda r: (r[1], r[0]))
    df = spark.createDataFrame([(*r, 1) for r in rows], "seq long, us long, terms array<string>, k int")
    got = {r["seq"]: r["cluster"] for r in clusters.greedy(df, ["k"], 45, 0.4).collect()}
    assert [got[r[0]] for r in rows] == plain_greedy(rows, 45 * MIN, 0.4) and len(set(got.values())) > 10


def test_windows_and_missions_are_those_of_plain_folds(spark):
    import random

    rng = random.Random(9)
    rows = sorted((rng.randrange(3000) * MIN, i) for i in range(400))
    df = spark.createDataFrame([(1, us, i, [rng.choice("abc")]) for us, i in rows], "k int, us long, seq long, content array<string>")
    windows, anchor, n = {}, None, -1
    for us, i in rows:
        if anchor is None or us - anchor > 30 * MIN:
            anchor, n = us, n + 1
        windows[i] = (n, anchor)
    got = {r["seq"]: (r["window"], r["anchor_us"]) for r in temporal.anchored_windows(df, ["k"], 30).collect()}
    assert got == windows
    content = {r["seq"]: set(r["content"]) for r in df.collect()}
    missions, n, last, opener = {}, -1, None, set()
    for us, i in rows:
        if last is None or us - last > 9 * MIN or not opener & content[i]:
            n, opener = n + 1, content[i]
        last = us
        missions[i] = n
    assert {r["seq"]: r["mission"] for r in temporal.search_missions(df, ["k"], 9).collect()} == missions


def test_engagement(spark):
    v = visits(spark, [(1, MIN, "https://a.com/1", "one two three four five words"), (2, 20 * MIN, "https://a.com/2", "TypeError in map() call")])
    s = spark.createDataFrame([(1, 0)], "seq long, us long")
    got = {r["seq"]: r["engagement"] for r in engagement.scores(v, engagement.linked_urls(s, v, 5, [])).collect()}
    assert got == {1: pytest.approx(0.50), 2: pytest.approx(0.15)}


def test_sensitive_rules(spark):
    v = visits(spark, [(1, 0, "https://x.bank.com/a", "t"), (2, 0, "https://notbank.com/", "t"), (3, 0, "https://site.org/health/x", "t"), (4, 0, "https://site.org/other", "t")])
    dims = spark.createDataFrame([(1, "finance", "bank.com"), (2, "health", "site.org/health")], "priority int, category string, pattern string")
    got = engagement.redact(engagement.sensitive(v, dims)).orderBy("seq").collect()
    assert [r["sensitive_category"] for r in got] == ["finance", None, "health", None] and got[0]["url"] == "https://x.bank.com/[FILTERED]" and got[2]["title"] == "[health]"


def test_rule_priority(spark):
    rows = spark.createDataFrame([(1, "a.b.com"), (2, "b.com"), (3, "c.com"), (4, "docs.c.com")], "seq long, domain string")
    dims = spark.createDataFrame([(3, "x", "b.com", "exact"), (2, "y", "b.com", "suffix"), (1, "z", "docs", "prefix")], "priority int, category string, pattern string, kind string")
    got = {r["seq"]: r["category"] for r in joins.by_domain_rule(rows, dims).collect()}
    assert got == {1: "y", 2: "x", 3: None, 4: "z"}


def test_classifier_fallback(spark):
    raw = spark.createDataFrame([(i, i, "search", f'"jwt {i}" (google.com)', None, None) for i in range(20)], classify.RAW)
    out = classify.by_model(raw, lambda texts: [{"activity_type": "nonsense"} if "3" in t else {"activity_type": "learning", "confidence": 9} for t in texts]).collect()
    assert {r["activity_type"] for r in out} == {"learning", "research"} and all(r["confidence"] == 1.0 for r in out if r["activity_type"] == "learning")


def test_answers_go_in_by_columns(spark):
    raw = spark.createDataFrame([(i, i, "search", f'"jwt {i}" (google.com)', None, None) for i in range(40)], classify.RAW)
    sizes = lambda texts: [{"activity_type": "learning", "summary": "s" * 200, "confidence": len(texts)} for _ in texts]
    out = classify.by_model(raw, sizes)
    assert "MapInArrow" in out._jdf.queryExecution().toString() and "MapInPandas" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == 40 and all(r["summary"] == "s" * 120 and r["confidence"] == 1.0 and r["topics"] is not None for r in rows)
    with pytest.raises(Exception, match="answers to"):
        classify.by_model(raw, lambda texts: []).collect()


def test_rules_once_are_those_of_each_row(spark):
    texts = ["jwt auth", "fix the bug", None, "fix the bug", ""]
    raw = spark.createDataFrame([(i, i, s, t, c, d) for i, (t, s, c, d) in enumerate((t, s, c, d) for t in texts for s in ("search", "claude", "browser", "git") for c in (None, "dev") for d in (None, "a.org"))], classify.RAW)
    got, want = classify.by_rules_once(raw), classify.by_rules(raw)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tiers_budgets_and_reports(spark):
    df = spark.createDataFrame([("browser", "secret text", "dev")], "source string, text string, activity_type string")
    assert reports.tier_view(df, 4).columns == ["activity_type"] and "text" in reports.tier_view(df, 1).columns
    shares = {r["source"]: r["share"] for r in reports.budget_shares(spark.createDataFrame([("a", 90), ("b", 10), ("c", 0)], "source string, n long"), 1000).collect()}
    assert shares == {"a": 820, "b": 180, "c": 0}
    assert reports.markdown(spark.createDataFrame([("a|b", 1)], "x string, n int"), "T").splitlines()[-1] == "| a\\|b | 1 |"
    ids = reports.numbered_ids(spark.createDataFrame([("q", 1), ("q", 2), ("r", 3)], "id string, n int"), "id", ["n"])
    assert sorted(r["unique_id"] for r in ids.collect()) == ["q", "q_2", "r"]
