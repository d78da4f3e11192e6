"""Rollups, budgets, costs, tiers and gates over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scrub, urls
from ..operators import classify, evaluation, patterns, reports
from ..sources import driver_tables as t
from . import q_sets, sql
from .registry import query

Q = sql.text


@query("SELECT l_orderkey, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) AS insertions, CAST(sum(floor(l_tax * 100)) AS BIGINT) AS deletions, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS renamed FROM lineitem GROUP BY 1")
def a14_numstat(spark, d):
    li = t.table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum("l_quantity").cast("long").alias("insertions"), F.sum(F.floor(F.col("l_tax") * 100)).cast("long").alias("deletions"), F.count_if(F.col("l_returnflag") == "R").alias("renamed"))


HOSTS = f"SELECT coalesce(min_by(category, priority), 'other') AS category, any_value(domain) AS domain FROM (SELECT seq, {sql.host('url')} AS domain FROM visits) v LEFT JOIN ({q_sets.RULES_SQL}) ON {q_sets.MATCH} GROUP BY v.seq"


@query(sql.over("visits", f"SELECT category, domain, n, CAST(total AS BIGINT) AS total FROM (SELECT category, domain, n, sum(n) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY n DESC, domain) AS k FROM (SELECT category, domain, count(*) AS n FROM ({HOSTS}) GROUP BY ALL)) WHERE k <= 5"))
def a26_category_rollup(spark, d):
    from ..operators import joins

    v = joins.by_domain_rule(t.visits(spark, d).select("seq", urls.host(F.col("url")).alias("domain")), q_sets.rules_dim(spark))
    return reports.two_levels(v.withColumn("category", F.coalesce("category", F.lit("other"))), "category", "domain", 5)


@query(sql.over("commits", "SELECT repo, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, count(DISTINCT message) AS messages FROM commits GROUP BY 1"))
def a26_repo_rollup(spark, d):
    return t.commits(spark, d).groupBy("repo").agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count_distinct("message").alias("messages"))


COUNTS = "SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1"


@query(f"WITH c AS ({COUNTS}), a AS (SELECT *, count(*) FILTER (n > 0) OVER () AS active, sum(n) OVER () AS total FROM c), f AS (SELECT *, least(floor(3000 * 0.1), floor(3000 / active)) AS floor_ FROM a) SELECT source, n, CAST(floor_ + floor((3000 - active * floor_) * n / total + 0.5) AS BIGINT) AS share FROM f")
def a27_budget_shares(spark, d):
    return reports.budget_shares(t.table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n")), 3000)


def costs(spark, d):
    o = t.table(spark, d, "orders")
    return o.select(F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("provider"), F.concat(F.lit("persona"), F.col("o_custkey") % 5).alias("persona"), F.col("o_orderpriority").alias("tier"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("input_tokens"), F.floor(F.col("o_totalprice")).cast("decimal(18,0)").cast("double").alias("cost"))


COSTS = "SELECT concat('p', o_custkey % 3) AS provider, concat('persona', o_custkey % 5) AS persona, o_orderpriority AS tier, CAST(floor(o_totalprice / 10) AS BIGINT) AS input_tokens, floor(o_totalprice) AS cost FROM orders"


@query(f"WITH c AS ({COSTS}) SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(persona) = 0 THEN 'persona' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS level, coalesce(provider, persona, tier, '') AS name, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(cost), 4) AS cost, round(sum(cost) * 7, 3) AS week, round(sum(cost) * 30, 3) AS month FROM c GROUP BY GROUPING SETS ((), (provider), (persona), (tier))")
def a29_cost_grouping_sets(spark, d):
    return reports.cost_rollup(costs(spark, d))


@query(f"WITH c AS ({COSTS}), p AS (SELECT provider, sum(cost) AS total FROM c GROUP BY 1) SELECT provider, round(total * 365, 2) AS year, total = min(total) OVER () AS cheapest, round(total / min(total) OVER (), 6) AS ratio FROM p")
def a33_provider_costs(spark, d):
    from pyspark.sql import Window

    p = costs(spark, d).groupBy("provider").agg(F.sum("cost").alias("total"))
    low = F.min("total").over(Window.partitionBy(F.lit(1)))
    return p.select("provider", F.round(F.col("total") * 365, 2).alias("year"), (F.col("total") == low).alias("cheapest"), F.round(F.col("total") / low, 6).alias("ratio"))


@query("SELECT l_returnflag AS provider, round(avg((coalesce(l_discount, 0) * 2 + coalesce(l_tax, 0) * 1 + CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 0 END * 1) / 4), 6) AS score FROM lineitem GROUP BY 1")
def a31_weighted_score(spark, d):
    li = t.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("provider"), "l_discount", "l_tax", F.when(F.col("l_linestatus") == "O", 0.5).otherwise(0.0).alias("open"))
    return reports.weighted_score(li, "provider", {"l_discount": 2.0, "l_tax": 1.0, "open": 1.0}).select("provider", F.round("score", 6).alias("score"))


@query("SELECT l_returnflag AS provider, round(avg(l_discount), 6) AS q1, round(avg(l_tax), 6) AS q2, bool_and(l_discount <= 0.1) AS ok, count(DISTINCT l_linestatus) = 1 AS homogeneous FROM lineitem GROUP BY 1")
def a30_quality_averages(spark, d):
    return t.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(F.round(F.avg("l_discount"), 6).alias("q1"), F.round(F.avg("l_tax"), 6).alias("q2"), F.bool_and(F.col("l_discount") <= 0.1).alias("ok"), (F.count_distinct("l_linestatus") == 1).alias("homogeneous"))


@query("SELECT c_mktsegment AS persona, count(*) AS n, CASE WHEN avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) < 0.95 THEN 'regression' ELSE 'ok' END AS verdict FROM customer GROUP BY 1")
def a34_regression_gate(spark, d):
    share = F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0))
    return t.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("persona")).agg(F.count("*").alias("n"), F.when(share < 0.95, "regression").otherwise("ok").alias("verdict"))


@query("""WITH c AS (SELECT c_mktsegment AS name, avg(greatest(c_acctbal, 0)) AS quality FROM customer GROUP BY 1), p AS (SELECT c_mktsegment AS name, avg(greatest(c_acctbal, 0)) AS quality FROM customer WHERE c_nationkey < 12 AND c_mktsegment <> 'AUTOMOBILE' GROUP BY 1),
    l AS (SELECT quality FROM c WHERE name = 'BUILDING')
    SELECT c.name, CASE WHEN p.quality IS NULL THEN 'baseline' WHEN c.quality < p.quality * 0.95 THEN 'block-merge' ELSE 'approve' END AS regression, c.quality >= CASE c.name WHEN 'MACHINERY' THEN 4600 ELSE 4400 END AS meets,
      CASE WHEN c.quality - (SELECT quality FROM l) > 50 THEN 'recommended' ELSE 'local-sufficient' END AS choice FROM c LEFT JOIN p USING (name)""")
def a34_decisions(spark, d):
    rows = t.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.greatest("c_acctbal", F.lit(0)).alias("q"), "c_nationkey")
    earlier = rows.where("c_nationkey < 12 AND name <> 'AUTOMOBILE'")
    mean = lambda df: df.groupBy("name").agg(F.avg("q").alias("quality"))
    return reports.decisions(mean(rows), mean(earlier), "BUILDING", {"MACHINERY": 4600.0}, 4400.0, 50.0)


@query("SELECT user_id, strftime(min(ts), '%H:%M') AS first, strftime(max(ts), '%H:%M') AS last FROM events GROUP BY 1")
def a35_time_range(spark, d):
    g = t.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", F.date_format("a", "HH:mm").alias("first"), F.date_format("b", "HH:mm").alias("last"))


@query(sql.over("classified", "SELECT x AS topic, count(*) AS n FROM (SELECT unnest(topics) AS x FROM classified) GROUP BY 1 ORDER BY n DESC, topic LIMIT 8"))
def a24_topic_map(spark, d):
    return reports.top_n(t.classified(spark, d).select(F.explode("topics").alias("topic")), "topic", 8)


@query(sql.over("classified", "SELECT activity_type, count(*) AS n, (SELECT count(DISTINCT x) FROM (SELECT unnest(topics) AS x FROM classified y WHERE y.activity_type = c.activity_type)) AS topics, (SELECT count(DISTINCT x) FROM (SELECT unnest(entities) AS x FROM classified y WHERE y.activity_type = c.activity_type)) AS entities FROM classified c GROUP BY 1"))
def a28_by_type_sections(spark, d):
    e = t.classified(spark, d)
    n = e.groupBy("activity_type").agg(F.count("*").alias("n"))
    kinds = [e.select("activity_type", F.explode(c).alias("x")).groupBy("activity_type").agg(F.count_distinct("x").alias(c)) for c in ("topics", "entities")]
    return n.join(kinds[0], "activity_type").join(kinds[1], "activity_type")


@query(sql.over("classified", """WITH c AS (SELECT activity_type, hour, count(*) AS n FROM classified GROUP BY ALL), p AS (SELECT a, b, count(*) AS n FROM (SELECT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT entities, unnest(entities) AS x FROM classified), unnest(entities) AS u(y) WHERE x < y) GROUP BY ALL),
    s AS (SELECT activity_type AS tag, max(n) / (SELECT max(n) FROM c) AS s FROM c GROUP BY 1 UNION ALL SELECT tag, max(n) / (SELECT max(n) FROM p) FROM (SELECT a AS tag, n FROM p UNION ALL SELECT b, n FROM p) GROUP BY 1)
    SELECT tag, round(max(s), 6) AS score FROM s GROUP BY 1 HAVING max(s) >= 0.1 ORDER BY max(s) DESC, tag LIMIT 10"""))
def a23_tag_scores(spark, d):
    e = t.classified(spark, d)
    c = e.groupBy("activity_type", "hour").agg(F.count("*").alias("intensity")).select(F.array("activity_type").alias("topics"), "intensity")
    return patterns.tag_scores(c, patterns.entity_relations(e, 1, None)).select("tag", F.round("score", 6).alias("score"))


LEAK = " + ".join(f"len(list_filter(regexp_extract_all(text, {Q(p.replace(scrub.B, chr(92) + 'b').replace(scrub.E, chr(92) + 'b'))}), lambda x: NOT regexp_matches(lower(x), 'test|fake|\\[redacted')))" for p, _ in scrub.SECRETS[1:])


@query(f"SELECT doc_id, CAST({LEAK} AS INTEGER) AS leaks FROM documents")
def f17_leaks(spark, d):
    return t.table(spark, d, "documents").select("doc_id", scrub.leaks(F.col("text")).alias("leaks"))


@query(f"SELECT source, sum(leaks) = 0 AS compliant, bool_or(leaks > 0) AS any_leak, count(*) AS n FROM (SELECT source, {LEAK} AS leaks FROM documents) GROUP BY 1")
def f18_privacy_gate(spark, d):
    rows = t.table(spark, d, "documents").select("source", scrub.leaks(F.col("text")).alias("leaks"))
    return rows.groupBy("source").agg((F.sum("leaks") == 0).alias("compliant"), F.bool_or(F.col("leaks") > 0).alias("any_leak"), F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT source, text, n_chars, {LEAK} AS leaks, (n_chars % 103) / 100.0 AS score FROM documents),
    c AS (SELECT source, count(*) AS checked, [count(*) FILTER (trim(text) = ''), count(*) FILTER (length(text) <> n_chars), count(*) FILTER (length(text) < 200), count(*) FILTER (rtrim(text) LIKE '%...' OR rtrim(text) LIKE '%…'), count(*) FILTER (leaks > 0), count(*) FILTER (score > 1)] AS f FROM d GROUP BY 1)
    SELECT source, ['present', 'stated size', 'least size', 'whole', 'no secrets', 'score in range'][k] AS rule, checked, f[k] AS failed, f[k] = 0 AS passed FROM c, range(1, 7) AS r(k)""")
def f19_output_rules(spark, d):
    docs = t.table(spark, d, "documents")
    rules = evaluation.output_rules(F.col("text"), F.col("n_chars"), 200, scrub.leaks(F.col("text")), F.col("n_chars") % 103 / 100)
    return evaluation.violations(docs, rules, ["source"])


@query("""WITH r AS (SELECT CASE source WHEN 'src0' THEN 'mock' WHEN 'src1' THEN 'local' ELSE source END AS provider, CASE lang WHEN 'en' THEN 'Focused dev' WHEN 'de' THEN 'productive' ELSE lang END AS persona, left(text, CAST(doc_id % 200 AS INTEGER)) AS headline, doc_id % 4 AS patterns, n_chars % 3 AS connections, CAST((n_chars % 101) AS DOUBLE) / 100 AS focus, n_chars AS tin, doc_id % 500 AS tout FROM documents),
    s AS (SELECT *, CASE WHEN contains(lower(persona), 'focused') THEN CASE WHEN focus >= 0.75 THEN 20 WHEN focus >= 0.6 THEN 10 ELSE 0 END WHEN contains(lower(persona), 'productive') THEN CASE WHEN focus >= 0.75 THEN 20 WHEN focus >= 0.65 THEN 10 ELSE 0 END
        ELSE CASE WHEN focus >= 0.5 AND focus <= 0.9 THEN 20 WHEN focus >= 0.35 THEN 10 ELSE 0 END END AS fp FROM r),
    q AS (SELECT *, least(100, 50 + fp + CASE WHEN length(headline) BETWEEN 20 AND 150 THEN 20 WHEN length(headline) BETWEEN 10 AND 19 THEN 10 ELSE 0 END + CASE WHEN patterns >= 2 THEN 30 WHEN patterns = 1 THEN 15 ELSE 0 END + CASE WHEN connections >= 2 THEN 20 WHEN connections = 1 THEN 10 ELSE 0 END) AS q FROM s),
    b AS (SELECT persona, CAST(sum(patterns) AS DOUBLE) / count(*) AS bp, CAST(sum(connections) AS DOUBLE) / count(*) AS bc, CAST(sum(CAST(focus AS DECIMAL(9,6))) AS DOUBLE) / count(*) AS bf FROM q WHERE provider = 'mock' GROUP BY 1),
    m AS (SELECT q.*, bf, CASE WHEN bp > 0 THEN CASE WHEN abs(patterns / bp - 1) > 0.5 THEN 30 WHEN abs(patterns / bp - 1) > 0.05 THEN 10 ELSE 0 END WHEN patterns > 0 THEN 5 ELSE 0 END + CASE WHEN abs(focus - bf) > 0.2 THEN 20 WHEN abs(focus - bf) > 0.1 THEN 10 ELSE 0 END
        + CASE WHEN bc > 0 THEN CASE WHEN abs(connections / bc - 1) > 0.5 THEN 20 WHEN abs(connections / bc - 1) > 0.05 THEN 5 ELSE 0 END WHEN connections > 0 THEN 2 ELSE 0 END AS lost FROM q LEFT JOIN b USING (persona)),
    g AS (SELECT provider, persona, count(*) AS n, CASE WHEN provider IN ('mock', 'local') THEN 0 ELSE (CAST(sum(tin) AS DOUBLE) * 0.8 + CAST(sum(tout) AS DOUBLE) * 0.4) / 1000000 END AS cost, CAST(sum(q) AS DOUBLE) / count(*) / 100 AS quality, CASE WHEN max(bf) IS NULL THEN NULL ELSE CAST(sum(greatest(0, 100 - lost)) AS DOUBLE) / count(*) / 100 END AS consistency FROM m GROUP BY 1, 2)
    SELECT g.provider, g.persona, g.n, round(g.cost, 8) AS cost, round(g.quality, 8) AS quality, round(g.consistency, 8) AS consistency, round(g.cost - o.cost, 8) AS cost_delta, round(g.quality - o.quality, 8) AS quality_delta FROM g LEFT JOIN g o ON o.persona = g.persona AND o.provider = 'mock'""")
def m10_provider_comparison(spark, d):
    swapped = lambda c, to: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in to.items()], F.col(c))
    rows = t.table(spark, d, "documents").select(
        swapped("source", {"src0": "mock", "src1": "local"}).alias("provider"), swapped("lang", {"en": "Focused dev", "de": "productive"}).alias("persona"), F.col("text").substr(F.lit(1), (F.col("doc_id") % 200).cast("int")).alias("headline"),
        (F.col("doc_id") % 4).alias("patterns"), (F.col("n_chars") % 3).alias("connections"), (F.col("n_chars") % 101 / 100).alias("focus"), F.col("n_chars").alias("tokens_in"), (F.col("doc_id") % 500).alias("tokens_out"))
    return evaluation.compare_providers(rows).select("provider", "persona", "n", *[F.round(c, 8).alias(c) for c in ("cost", "quality", "consistency", "cost_delta", "quality_delta")])


@query("SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= 100 THEN text WHEN ceil(length(left(text, 400)) / 4.0) <= 100 THEN left(text, 400) ELSE concat(n_chars, ' characters') END AS shown FROM documents")
def m7_fit_text(spark, d):
    return t.table(spark, d, "documents").select("doc_id", reports.fit_text(F.col("text"), F.substring("text", 1, 400), F.concat(F.col("n_chars").cast("string"), F.lit(" characters")), F.lit(100)).alias("shown"))


@query(sql.over("classified", """WITH v AS (SELECT activity_type, array_to_string(list_sort(topics), ',') AS topics, array_to_string(list_sort(entities), ',') AS entities FROM classified),
    s AS (SELECT unnest([1, 2]) AS tier, concat_ws('|', entities, topics) AS shown FROM v UNION ALL SELECT 3, concat_ws('|', activity_type, topics) FROM v UNION ALL SELECT 4, activity_type FROM v) SELECT tier, shown, count(*) AS n FROM s GROUP BY ALL"""))
def p33_tier_view(spark, d):
    """What each tier lets through."""
    e = t.classified(spark, d)
    views = {tier: reports.tier_view(e, tier) for tier in (1, 2, 3, 4)}
    shown = lambda v: F.concat_ws("|", *[F.array_join(F.array_sort(c), ",") if c in ("topics", "entities") else F.col(c) for c in sorted(v.columns)])
    parts = [v.select(F.lit(tier).alias("tier"), shown(v).alias("shown")) for tier, v in views.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("tier", "shown").agg(F.count("*").alias("n"))


@query(sql.over("searches", "SELECT seq, CASE WHEN length(query) % 2 = 1 THEN 'learning' ELSE 'research' END AS activity_type, CASE WHEN length(query) % 2 = 1 THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence FROM searches"))
def m1_model_classifier(spark, d):
    """A classifier that answers only some texts, by their length; the rules stand for the rest."""
    around = len('"" (google.com)')

    def answer(texts):
        return [{"activity_type": "learning", "confidence": 2} if (len(x) - around) % 2 else {"activity_type": "no such"} if len(x) % 4 else None for x in texts]

    raw = classify.raw_searches(t.searches(spark, d))
    return classify.by_model(raw, answer).select("seq", "activity_type", "confidence")


TOOL_WORDS = "(^|[^A-Za-z0-9_])(" + "|".join(scrub.TOOLS) + ")([^A-Za-z0-9_]|$)"


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(x, '(?i)https?://[^\\s]+') THEN 'urls' END, CASE WHEN regexp_matches(x, '(?:/[^\\s]+|[A-Z]:\\\\[^\\s]+)') THEN 'paths' END, CASE WHEN regexp_matches(lower(x), {Q(TOOL_WORDS)}) THEN 'tools' END) AS violations
    FROM (SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' see HTTP://x' WHEN 1 THEN ' in C:\\x' WHEN 2 THEN ' by Docker-Compose' ELSE ' gitx' END) AS x FROM documents)""")
def f17_tier_violations(spark, d):
    n = F.col("doc_id") % 4
    x = F.concat("text", F.when(n == 0, " see HTTP://x").when(n == 1, " in C:\\x").when(n == 2, " by Docker-Compose").otherwise(" gitx"))
    return t.table(spark, d, "documents").select("doc_id", F.array_join(scrub.tier_violations(x), ",").alias("violations"))


@query(sql.over("commits searches", """WITH e AS (SELECT 'git' AS source, repo AS part, repo || ': ' || message AS line FROM commits UNION ALL SELECT 'search', engine, query FROM searches UNION ALL SELECT 'one', 'p', 'a line'),
    f AS (SELECT source, count(*) AS n, ceil((sum(length(line) + 1) - 1) / 4) AS cost, string_agg(line, chr(10) ORDER BY line) AS body FROM e GROUP BY 1),
    p AS (SELECT source, part || ': ' || count(*) AS line FROM e GROUP BY source, part), g AS (SELECT source, ceil((sum(length(line) + 1) - 1) / 4) AS cost, string_agg(line, chr(10) ORDER BY line) AS body FROM p GROUP BY 1),
    s AS (SELECT f.source, f.n, f.cost AS full_cost, g.cost AS grouped_cost, f.body AS full_body, g.body AS grouped_body, least(300, 3000 // count(*) OVER ()) AS floor_, count(*) OVER () AS k, sum(f.n) OVER () AS total FROM f JOIN g USING (source)),
    t AS (SELECT *, floor_ + floor((3000 - k * floor_) * n / total + 0.5) AS share FROM s)
    SELECT source, CASE WHEN full_cost <= share THEN 'full' WHEN grouped_cost <= share THEN 'grouped' ELSE 'count' END AS level, CASE WHEN full_cost <= share THEN full_body WHEN grouped_cost <= share THEN grouped_body ELSE n || ' events' END AS body FROM t"""))
def m7_compressed_sources(spark, d):
    """Sources in what detail a budget allows."""
    git = t.commits(spark, d).select(F.lit("git").alias("source"), F.col("repo").alias("part"), F.concat("repo", F.lit(": "), "message").alias("line"))
    asked = t.searches(spark, d).select(F.lit("search").alias("source"), F.col("engine").alias("part"), F.col("query").alias("line"))
    return reports.compressed(git.unionByName(asked).unionByName(spark.createDataFrame([("one", "p", "a line")], git.schema)), 3000)


@query(sql.over("searches prompts commits", f"SELECT source, activity_type, count(*) AS n FROM (SELECT 'search' AS source, 'research' AS activity_type FROM searches UNION ALL SELECT 'git', 'implementation' FROM commits UNION ALL SELECT 'claude', {sql.lookup(sql.task_type('left(prompt, 150)'), __import__('tallyloom.functions.rules', fromlist=['x']).TASK_ACTIVITIES, Q('unknown'))} FROM prompts) GROUP BY ALL"))
def m2_rule_classification(spark, d):
    raw = classify.raw_searches(t.searches(spark, d)).unionByName(classify.raw_prompts(t.prompts(spark, d))).unionByName(classify.raw_commits(t.commits(spark, d)))
    return classify.by_rules(raw).groupBy("source", "activity_type").agg(F.count("*").alias("n"))


@query(sql.over("classified", "SELECT entity FROM (SELECT DISTINCT unnest(entities) AS entity FROM classified) WHERE NOT contains('my tool12 notes', lower(entity)) AND NOT contains('tool3', lower(entity))"))
def j18_novel_entities(spark, d):
    names = t.classified(spark, d).select(F.explode("entities").alias("entity")).distinct()
    return patterns.novel_entities(names, spark.createDataFrame([("My Tool12 notes",), ("tool3",)], "topic string"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS INTEGER) AS n_words, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS breaks FROM documents")
def s18_text_structure(spark, d):
    x = F.col("text")
    return t.table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("n_words"), (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).alias("breaks"))




@query(sql.over("classified", "SELECT x AS topic, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT unnest(topics) AS x, n FROM classified JOIN (SELECT activity_type, hour, count(*) AS n FROM classified GROUP BY ALL) USING (activity_type, hour)) GROUP BY 1 ORDER BY weight DESC, topic LIMIT 12"))
def a25_weighted_topics(spark, d):
    e = t.classified(spark, d)
    sizes = e.groupBy("activity_type", "hour").agg(F.count("*").alias("n"))
    rows = e.join(sizes, ["activity_type", "hour"]).select(F.explode("topics").alias("topic"), "n")
    return rows.groupBy("topic").agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "topic").limit(12)


@query("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w * 100 // count(*) OVER w AS BIGINT) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def a22_running_mean(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.table(spark, d, "events").select("event_id", F.call_function("div", F.sum(F.round(F.col("value") * 100).cast("long")).over(w) * 100, F.count("*").over(w)).alias("mean"))


PAIRS = """WITH x AS (SELECT user_id, day, list_sort(list_distinct(flatten(list(topics)))) AS ts FROM classified GROUP BY ALL), u AS (SELECT user_id, day, ts, unnest(ts) AS a FROM x),
    p AS (SELECT a, b, count(*) AS shared FROM (SELECT a, unnest(ts) AS b FROM u) WHERE a < b GROUP BY ALL), s AS (SELECT *, shared / max(shared) OVER () AS strength FROM p)"""


def day_pairs(spark, d):
    from pyspark.sql import Window

    days = t.classified(spark, d).groupBy("user_id", "day").agg(F.array_distinct(F.flatten(F.collect_set("topics"))).alias("topics"))
    counts = patterns.pairs(days, [], "topics").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return counts.withColumn("strength", F.col("shared") / F.max("shared").over(Window.partitionBy(F.lit(1))))


@query(sql.over("classified", f"{PAIRS} SELECT a, b, shared, round(strength, 6) AS strength FROM s WHERE strength >= 0.5"))
def f14_strong_pairs(spark, d):
    return day_pairs(spark, d).where("strength >= 0.5").select("a", "b", "shared", F.round("strength", 6).alias("strength"))


@query(sql.over("classified", f"""{PAIRS} SELECT 'connection' AS kind, concat(a, ' ↔ ', b) AS name FROM (SELECT * FROM s WHERE strength >= 0.5 ORDER BY strength DESC, a, b LIMIT 8)
    UNION ALL SELECT 'new', x FROM (SELECT x, min(day) AS f FROM (SELECT unnest(topics) AS x, day FROM classified) GROUP BY 1) WHERE f >= DATE '2024-01-01'
    UNION ALL SELECT 'entity', x FROM (SELECT DISTINCT unnest(entities) AS x FROM classified) WHERE NOT contains('tool1 tool7', lower(x))"""))
def a11_knowledge_delta(spark, d):
    """What a day adds: strong connections, new topics, novel entities."""
    e = t.classified(spark, d)
    strong = day_pairs(spark, d).where("strength >= 0.5").orderBy(F.desc("strength"), "a", "b").limit(8)
    first = e.select(F.explode("topics").alias("x"), "day").groupBy("x").agg(F.min("day").alias("f")).where("f >= date'2024-01-01'")
    new = patterns.novel_entities(e.select(F.explode("entities").alias("entity")).distinct(), spark.createDataFrame([("tool1 tool7",)], "topic string"))
    return strong.select(F.lit("connection").alias("kind"), F.concat("a", F.lit(" ↔ "), "b").alias("name")).unionByName(first.select(F.lit("new").alias("kind"), F.col("x").alias("name"))).unionByName(new.select(F.lit("entity").alias("kind"), F.col("entity").alias("name")))


@query("SELECT 'missing' AS problem, CAST(o_custkey AS BIGINT) AS id FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) UNION ALL SELECT 'unused', c_custkey FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0 EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'repeated', o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def j21_registry_consistency(spark, d):
    o, c = t.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), t.table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"))
    tag = lambda df, x: df.select(F.lit(x).alias("problem"), F.col("id").cast("long").alias("id"))
    return tag(o.distinct().exceptAll(c), "missing").unionByName(tag(c.exceptAll(o.distinct()), "unused")).unionByName(tag(o.groupBy("id").count().where("count > 12"), "repeated"))


@query(sql.over("visits", f"SELECT v.seq, coalesce(m.category, 'other') AS category FROM (SELECT seq, {sql.host('url')} AS domain FROM visits) v LEFT JOIN (SELECT domain, max(category) AS category FROM ({HOSTS}) WHERE category <> 'other' GROUP BY 1) m USING (domain)"))
def j7_known_categories(spark, d):
    """Categories from the grouped visits, by equi-join, with a fallback."""
    from ..operators import joins

    v = t.visits(spark, d).select("seq", urls.host(F.col("url")).alias("domain"))
    known = joins.by_domain_rule(v, q_sets.rules_dim(spark)).where("category is not null").groupBy("domain").agg(F.max("category").alias("category"))
    return v.join(known, "domain", "left").select("seq", F.coalesce("category", F.lit("other")).alias("category"))
