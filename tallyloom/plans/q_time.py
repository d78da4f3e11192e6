"""Queries over time: sessions, islands, windows, chains, focus and recurrence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, urls, words
from ..operators import clusters, joins, patterns, reports, state, temporal
from ..sources import driver_tables as t
from . import sql
from .registry import query

Q = sql.text
SPLIT = "CASE WHEN us - lag(us) OVER w > {gap} OR us // 86400000000 <> lag(us) OVER w // 86400000000 THEN 1 ELSE 0 END"
SESSIONS = f"SELECT *, sum(f) OVER (PARTITION BY repo ORDER BY us, seq) + 1 AS session FROM (SELECT *, {SPLIT.format(gap=5400000000)} AS f FROM commits WINDOW w AS (PARTITION BY repo ORDER BY us, seq))"


@query(sql.over("commits", f"SELECT repo, seq, CAST(session AS BIGINT) AS session FROM ({SESSIONS})"))
def w3_commit_sessions(spark, d):
    return temporal.gap_sessions(t.commits(spark, d), ["repo"], 90).select("repo", "seq", "session")


@query(sql.over("commits", f"""WITH s AS (SELECT *, {sql.work_mode('message')} AS mode FROM ({SESSIONS})), g AS (SELECT *, mode = 'debugging' AS debug FROM s),
    m AS (SELECT repo, session, debug, mode, count(*) AS n, min(seq) AS first FROM g WHERE mode <> 'tweaking' GROUP BY ALL),
    top AS (SELECT repo, session, debug, mode FROM (SELECT *, row_number() OVER (PARTITION BY repo, session, debug ORDER BY n DESC, first) AS k FROM m) WHERE k = 1)
    SELECT repo, CAST(session AS BIGINT) AS session, debug, coalesce(any_value(top.mode), 'tweaking') AS work_mode, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, min(us) AS start_us, max(us) AS end_us, bool_and(regexp_matches(trim(message), {Q(rules.GENERIC)})) AS is_generic
    FROM g LEFT JOIN top USING (repo, session, debug) GROUP BY repo, session, debug"""))
def a15_work_units(spark, d):
    """Sessions of a repository, bug fixing apart from the rest."""
    return temporal.work_units(t.commits(spark, d), [], 90).drop("label", "why")


@query(sql.over("commits", f"""WITH s AS (SELECT *, {sql.work_mode('message')} AS mode, nullif(trim({sql.commit('message', 2)}), '') AS scope FROM ({SESSIONS})), g AS (SELECT *, mode = 'debugging' AS debug FROM s),
    m AS (SELECT repo, session, debug, mode, count(*) AS n, min(seq) AS first FROM g WHERE mode <> 'tweaking' GROUP BY ALL),
    o AS (SELECT repo, session, debug, scope, count(*) AS n, min(seq) AS first FROM g WHERE scope IS NOT NULL GROUP BY ALL),
    mode AS (SELECT repo, session, debug, arg_min(mode, [-n, first]) AS mode FROM m GROUP BY ALL), scope AS (SELECT repo, session, debug, arg_min(scope, [-n, first]) AS scope FROM o GROUP BY ALL)
    SELECT repo, CAST(session AS BIGINT) AS session, debug, CASE WHEN scope.scope IS NOT NULL THEN 'Feature work: ' || scope.scope ELSE repo || ': ' || coalesce(mode.mode, 'tweaking') END AS label
    FROM (SELECT DISTINCT repo, session, debug FROM g) LEFT JOIN mode USING (repo, session, debug) LEFT JOIN scope USING (repo, session, debug)"""))
def a15_unit_labels(spark, d):
    return temporal.work_units(t.commits(spark, d), [], 90).select("repo", "session", "debug", "label")


@query(sql.over("classified", "SELECT CAST(day AS VARCHAR) AS day, hour, activity_type, n FROM (SELECT *, row_number() OVER (PARTITION BY day, hour ORDER BY n DESC, first) AS k FROM (SELECT day, hour, activity_type, count(*) AS n, min(seq) AS first FROM classified GROUP BY ALL)) WHERE k = 1"))
def a2_dominant_activity(spark, d):
    return temporal.dominant(t.classified(spark, d), ["day", "hour"], "activity_type").withColumn("day", F.col("day").cast("string"))


ISLANDS = """WITH c AS (SELECT day, hour, activity_type, count(*) AS n, min(seq) AS first FROM classified GROUP BY ALL),
    m AS (SELECT day, hour, activity_type, (SELECT sum(n) FROM c x WHERE x.day = c.day AND x.hour = c.hour) AS total, row_number() OVER (PARTITION BY day, hour ORDER BY n DESC, first) AS k FROM c),
    i AS (SELECT *, hour - row_number() OVER (PARTITION BY day, activity_type ORDER BY hour) AS g FROM m WHERE k = 1),
    islands AS (SELECT day, activity_type, CAST(min(hour) AS INTEGER) AS hour_start, CAST(max(hour) AS INTEGER) AS hour_end, CAST(sum(total) AS BIGINT) AS event_count FROM i GROUP BY day, activity_type, g)"""


@query(sql.over("classified", f"{ISLANDS} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM islands WHERE event_count >= 3"))
def w5_hour_islands(spark, d):
    return temporal.hour_islands(t.classified(spark, d), ["day"]).where("event_count >= 3").withColumn("day", F.col("day").cast("string"))


@query(sql.over("classified", """WITH o AS (SELECT activity_type, hour, count(*) AS n FROM classified GROUP BY ALL), b AS (SELECT *, row_number() OVER (ORDER BY n DESC, hour, activity_type) AS k FROM o WHERE n > 50),
    i AS (SELECT k AS n, hour AS hour_start, least(23, hour + 2) AS hour_end FROM b WHERE k <= 4) SELECT seq, coalesce(CAST((SELECT min(n) FROM i WHERE c.hour BETWEEN hour_start AND hour_end) AS INTEGER), 0) AS n FROM classified c"""))
def j13_event_cluster(spark, d):
    e = t.classified(spark, d)
    top = e.groupBy("activity_type", "hour").agg(F.count("*").alias("c")).where("c > 50").orderBy(F.desc("c"), "hour", "activity_type").limit(4)
    i = top.select(F.row_number().over(Window.orderBy(F.desc("c"), "hour", "activity_type")).alias("n"), F.col("hour").alias("hour_start"), F.least(F.lit(23), F.col("hour") + 2).alias("hour_end"))
    return joins.first_interval(e.select("seq", "hour"), i).select("seq", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql.over("visits", "SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, seq) + 1 AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) > 5400000000 THEN 1 ELSE 0 END AS f FROM visits)) GROUP BY ALL"))
def w10_timeline_sessions(spark, d):
    s = temporal.gap_sessions(t.visits(spark, d), ["user_id"], 90, by_day=False)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query("SELECT CASE WHEN hour(ts) < 12 THEN 1 WHEN hour(ts) < 17 THEN 2 ELSE 3 END AS n, CASE WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 17 THEN 'Afternoon' ELSE 'Evening' END AS period, count(*) AS events, strftime(min(ts), '%H:%M') AS first, strftime(max(ts), '%H:%M') AS last FROM events GROUP BY ALL")
def w11_time_blocks(spark, d):
    p = words.period(F.hour("ts"))
    out = t.table(spark, d, "events").groupBy(p.alias("period")).agg(F.count("*").alias("events"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return out.select(F.when(F.col("period") == "Morning", 1).when(F.col("period") == "Afternoon", 2).otherwise(3).alias("n"), "period", "events", F.date_format("a", "HH:mm").alias("first"), F.date_format("b", "HH:mm").alias("last"))


@query(sql.over("prompts", "SELECT seq, row_number() OVER (PARTITION BY conversation ORDER BY us, seq) = 1 AS is_opener, count(*) OVER (PARTITION BY conversation) AS turn_count FROM prompts"))
def w8_opener_and_turns(spark, d):
    return temporal.opener_and_turns(t.prompts(spark, d), "conversation").select("seq", "is_opener", "turn_count")


@query(sql.over("prompts", f"""SELECT conversation, task_type, topic, turn_count, start_us, end_us, task_type IN ('learning', 'architecture') AND turn_count >= 5 AS is_deep FROM (
    SELECT conversation, {sql.task_type('opener')} AS task_type, {sql.prompt_topic('opener', Q('general'))} AS topic, turn_count, start_us, end_us FROM (SELECT conversation, min_by(prompt, seq) AS opener, count(*) AS turn_count, min(us) AS start_us, max(us) AS end_us FROM prompts GROUP BY 1))"""))
def a16_task_sessions(spark, d):
    files = t.prompts(spark, d).groupBy("conversation").agg(F.min_by("prompt", "seq").alias("opener"), F.count("*").alias("turn_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    kind = rules.task_type(F.col("opener"))
    deep = (rules.interaction_mode(kind) == "exploration") & (F.col("turn_count") >= 5)
    return files.select("conversation", kind.alias("task_type"), rules.prompt_topic(F.col("opener"), "general").alias("topic"), "turn_count", "start_us", "end_us", deep.alias("is_deep"))


@query(sql.over("classified", "SELECT activity_type, count(*) AS n, CAST(floor(100.0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent FROM classified GROUP BY 1"))
def a3_activity_distribution(spark, d):
    return patterns.activity_distribution(t.classified(spark, d))


@query(sql.over("classified", "SELECT hour, count(*) AS n FROM classified GROUP BY 1 ORDER BY n DESC, hour LIMIT 5"))
def a4_peak_hours(spark, d):
    return t.classified(spark, d).groupBy("hour").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(5)


FOCUS = """WITH m AS (SELECT user_id, lower(x) AS x, count(*) AS n FROM (SELECT user_id, unnest(topics) AS x FROM classified) GROUP BY ALL),
    f AS (SELECT user_id, greatest(0, least(1, 1 - (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(greatest(2, count(*))))) AS focus FROM m GROUP BY 1)"""


@query(sql.over("classified", f"{FOCUS} SELECT user_id, round(focus, 6) AS focus FROM f"))
def a5_topic_focus(spark, d):
    return patterns.topic_focus(t.classified(spark, d), ["user_id"]).select("user_id", F.round("focus", 6).alias("focus"))


@query(sql.over("classified", f"""{FOCUS}, c AS (SELECT user_id, max(n) / sum(n) AS top, sum(n) AS n_events FROM (SELECT user_id, activity_type, count(*) AS n FROM classified GROUP BY ALL) GROUP BY 1),
    s AS (SELECT user_id, n_events, 0.30 + 0.68 * (1 / (1 + exp(-5 * (0.6 * coalesce(focus, 0) + 0.4 * top - 0.5))) - 1 / (1 + exp(2.5))) / (1 / (1 + exp(-2.5)) - 1 / (1 + exp(2.5))) AS score FROM c LEFT JOIN f USING (user_id))
    SELECT user_id, CAST(n_events AS BIGINT) AS n_events, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'Highly focused' WHEN score >= 0.60 THEN 'Moderately focused' WHEN score >= 0.45 THEN 'Varied' ELSE 'Widely scattered' END AS label FROM s"""))
def a7_focus_score(spark, d):
    return patterns.focus_score(t.classified(spark, d), ["user_id"]).select("user_id", "n_events", F.round("score", 6).alias("score"), "label")


ANCHORS = """WITH a AS (SELECT user_id, day, min(us) AS us FROM classified GROUP BY ALL UNION ALL
    SELECT a.user_id, a.day, (SELECT min(c.us) FROM classified c WHERE c.user_id = a.user_id AND c.day = a.day AND c.us > a.us + 1800000000) AS us FROM a WHERE a.us IS NOT NULL),
    w AS (SELECT c.*, (SELECT max(a.us) FROM a WHERE a.user_id = c.user_id AND a.day = c.day AND a.us <= c.us) AS anchor_us FROM classified c)"""


def windowed(spark, d):
    e = t.classified(spark, d)
    return temporal.anchored_windows(e, ["user_id", "day"], 30).join(e.select("seq", "topics"), "seq")


@query(sql.over("classified", f"{ANCHORS} SELECT seq, anchor_us FROM w", recursive=True))
def w4_anchored_windows(spark, d):
    return temporal.anchored_windows(t.classified(spark, d), ["user_id", "day"], 30).select("seq", "anchor_us")


@query(sql.over("classified", f"""{ANCHORS}, k AS (SELECT user_id, day, anchor_us, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1), x AS (SELECT DISTINCT user_id, day, anchor_us, unnest(topics) AS t FROM w),
    p AS (SELECT a.t AS a, b.t AS b, count(*) AS shared, min(anchor_us) AS first_us FROM x a JOIN x b USING (user_id, day, anchor_us) JOIN k USING (user_id, day, anchor_us) WHERE a.t < b.t GROUP BY ALL)
    SELECT a, b, shared, first_us, round(shared / max(shared) OVER (), 6) AS strength FROM p""", recursive=True))
def a9_topic_pairs(spark, d):
    return patterns.cooccurrences(windowed(spark, d), ["user_id", "day"], None).select("a", "b", "shared", "first_us", F.round("strength", 6).alias("strength"))


@query(sql.over("searches", f"""WITH s AS (SELECT user_id, seq, us, list_distinct({sql.tokens('query')}) AS c, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS k FROM searches),
    m AS (SELECT user_id, seq, us, k, c AS opener, 0 AS mission FROM s WHERE k = 1 UNION ALL
      SELECT user_id, seq, us, k, CASE WHEN goes_on THEN opener ELSE c END, mission + CASE WHEN goes_on THEN 0 ELSE 1 END
      FROM (SELECT s.user_id, s.seq, s.us, s.k, s.c, m.opener, m.mission, s.us - m.us <= 86400000000 AND len(list_intersect(m.opener, s.c)) > 0 AS goes_on FROM m JOIN s ON s.user_id = m.user_id AND s.k = m.k + 1))
    SELECT user_id, seq, CAST(mission AS BIGINT) AS mission FROM m""", recursive=True))
def w6_search_missions(spark, d):
    rows = t.searches(spark, d).withColumn("content", words.content_words(F.col("query")))
    return temporal.search_missions(rows, ["user_id"], 60 * 24)


def topic_days(spark, d):
    return t.classified(spark, d).select(F.explode("topics").alias("topic"), "day").distinct()


HISTORY = """h AS (SELECT x AS topic, min(day) AS first_seen, max(day) AS last_seen, count(*) AS day_count, list_sort(list(day)) AS days FROM
    (SELECT DISTINCT unnest(topics) AS x, day FROM classified) WHERE day < DATE '2024-01-12' AND NOT (x = 'topic3' AND day > DATE '2024-01-03') AND x <> 'topic5' GROUP BY 1)"""


def history(spark, d):
    e = t.classified(spark, d).select(F.explode("topics").alias("topic"), "day").distinct()
    past = e.where("day < date'2024-01-12' and not (topic = 'topic3' and day > date'2024-01-03') and topic <> 'topic5'")
    return past.groupBy("topic").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("day_count"), F.sort_array(F.collect_set("day")).alias("recent_days"))


def today():
    return F.lit("2024-01-12").cast("date")


@query(sql.over("classified", f"WITH {HISTORY}, n AS (SELECT DISTINCT unnest(topics) AS topic FROM classified WHERE day = DATE '2024-01-12') SELECT topic, coalesce(day_count, 0) + 1 AS frequency, CASE WHEN last_seen IS NULL THEN 'new' WHEN last_seen < DATE '2024-01-05' THEN 'returning' WHEN len(list_filter(days, lambda x: x >= DATE '2023-12-29')) >= 5 THEN 'stable' WHEN len(list_filter(days, lambda x: x >= DATE '2023-12-29')) >= 3 THEN 'rising' ELSE 'declining' END AS trend, CAST(coalesce(first_seen, DATE '2024-01-12') AS VARCHAR) AS first_seen, coalesce(CAST(last_seen AS VARCHAR), '') AS prev_last_seen FROM n LEFT JOIN h USING (topic)"))
def t2_recurrence_signals(spark, d):
    return state.recurrence(topic_days(spark, d).where(F.col("day") == today()), history(spark, d), today()).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("first_seen", "prev_last_seen")})


SIGNALS = "SELECT topic, coalesce(day_count, 0) + 1 AS frequency, CASE WHEN last_seen IS NULL THEN 'new' WHEN last_seen < DATE '2024-01-05' THEN 'returning' WHEN len(list_filter(days, lambda x: x >= DATE '2023-12-29')) >= 5 THEN 'stable' WHEN len(list_filter(days, lambda x: x >= DATE '2023-12-29')) >= 3 THEN 'rising' ELSE 'declining' END AS trend FROM n LEFT JOIN h USING (topic)"


@query(sql.over("classified", f"WITH {HISTORY}, n AS (SELECT DISTINCT unnest(topics) AS topic FROM classified WHERE day = DATE '2024-01-12') SELECT topic, row_number() OVER (ORDER BY CASE trend WHEN 'new' THEN 0 WHEN 'returning' THEN 1 WHEN 'rising' THEN 2 WHEN 'stable' THEN 3 ELSE 4 END, frequency DESC, topic) AS place FROM ({SIGNALS})"))
def o4_recurrence_order(spark, d):
    """The topics of a day in the order of a report; they are few."""
    s = state.recurrence(topic_days(spark, d).where(F.col("day") == today()), history(spark, d), today())
    return s.select("topic", F.row_number().over(Window.orderBy(*state.by_trend(s))).cast("long").alias("place"))


@query(sql.over("classified", f"WITH {HISTORY}, n AS (SELECT DISTINCT unnest(topics) AS topic FROM classified WHERE day = DATE '2024-01-12') SELECT topic, CAST(coalesce(first_seen, DATE '2024-01-12') AS VARCHAR) AS first_seen, CAST(CASE WHEN n.topic IS NULL THEN last_seen ELSE DATE '2024-01-12' END AS VARCHAR) AS last_seen, coalesce(day_count, 0) + CASE WHEN n.topic IS NULL THEN 0 ELSE 1 END AS day_count, CAST(least(30, coalesce(len(days), 0) + CASE WHEN n.topic IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS kept FROM n FULL JOIN h USING (topic)"))
def t1_topic_state(spark, d):
    now = topic_days(spark, d).where(F.col("day") == today())
    once = state.update(history(spark, d), now, today())
    return state.update(once, now, today()).select("topic", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "day_count", F.size("recent_days").alias("kept"))


@query("SELECT event_id AS seq, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS day_n, count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW) AS last_14 FROM events")
def w13_look_back(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    w = Window.partitionBy("user_id").orderBy(day)
    return t.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.dense_rank().over(w).alias("day_n"), F.count("*").over(w.rangeBetween(-14, 0)).alias("last_14"))


TOK = sql.tokens("text")
TFIDF = f"""WITH tok AS (SELECT item_id, unnest({TOK}) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS n FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    sz AS (SELECT item_id, count(*) AS size FROM tf GROUP BY 1), v AS (SELECT item_id, term, n / size * (1 + ln((SELECT count(*) FROM benchmark) / df)) AS weight FROM tf JOIN df USING (term) JOIN sz USING (item_id))"""


@query(f"{TFIDF} SELECT item_id, term, round(weight, 6) AS weight FROM v")
def a17_tfidf(spark, d):
    return clusters.tfidf(t.table(spark, d, "benchmark"), "item_id", "text").select("item_id", "term", F.round("weight", 6).alias("weight"))


@query(f"{TFIDF}, nrm AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY 1) SELECT a.item_id AS q, b.item_id, round(sum(a.weight * b.weight) / any_value(x.norm * y.norm), 6) AS cosine FROM v a JOIN v b USING (term) JOIN nrm x ON x.item_id = a.item_id JOIN nrm y ON y.item_id = b.item_id WHERE a.item_id % 50 = 0 GROUP BY a.item_id, b.item_id")
def a18_cosine(spark, d):
    v = clusters.tfidf(t.table(spark, d, "benchmark"), "item_id", "text")
    q = v.where("item_id % 50 = 0").select(F.col("item_id").alias("q"), "term", "weight")
    return clusters.cosine_to(v, q, "item_id").select("q", "item_id", F.round("cosine", 6).alias("cosine"))


@query(f"{TFIDF} SELECT cluster, term, round(sum(weight) / any_value(n), 6) AS weight FROM (SELECT item_id % 5 AS cluster, term, weight FROM v) JOIN (SELECT item_id % 5 AS cluster, count(*) AS n FROM benchmark GROUP BY 1) USING (cluster) GROUP BY ALL")
def a19_centroids(spark, d):
    b = t.table(spark, d, "benchmark")
    return clusters.centroids(clusters.tfidf(b, "item_id", "text"), b.select("item_id", (F.col("item_id") % 5).alias("cluster")), "item_id").select("cluster", "term", F.round("weight", 6).alias("weight"))


@query("SELECT label, CAST(i AS INTEGER) AS dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def a19_dense_centroids(spark, d):
    rows = t.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg("x"), 5).alias("mean"))


@query(f"SELECT cluster, array_to_string(list(w ORDER BY n DESC, w)[1:3], ' ') AS label FROM (SELECT item_id % 5 AS cluster, w, count(*) AS n FROM (SELECT item_id, unnest({TOK}) AS w FROM benchmark) WHERE length(w) > 3 GROUP BY ALL) GROUP BY 1")
def a20_cluster_labels(spark, d):
    return clusters.labels(t.table(spark, d, "benchmark").withColumn("cluster", F.col("item_id") % 5), "text")


@query(sql.over("visits", f"SELECT cluster, CASE WHEN count(DISTINCT domain) >= 3 THEN 'research' WHEN max(n) > 1 THEN 'reference' ELSE 'browsing' END AS intent_signal FROM (SELECT user_id AS cluster, url, {sql.host('url')} AS domain, count(*) AS n FROM visits GROUP BY ALL) GROUP BY 1"))
def a21_cluster_intent(spark, d):
    rows = t.visits(spark, d).select(F.col("user_id").alias("cluster"), "url", urls.host(F.col("url")).alias("domain"))
    return clusters.cluster_intent(rows)


@query()
def w7_article_clusters(spark, d):
    rows = t.visits(spark, d).select("seq", "user_id", "us", F.floor(F.col("us") / 86_400_000_000).alias("day"), words.tokens(words.clean_title(F.col("title"))).alias("terms"))
    return clusters.greedy(rows, ["user_id", "day"], 45, 0.3)


def hour_sql(h: str) -> str:
    return f"CASE WHEN ({h}) % 24 = 0 THEN '12am' WHEN ({h}) < 12 THEN concat({h}, 'am') WHEN ({h}) = 12 THEN '12pm' ELSE concat(({h}) - 12, 'pm') END"


def named_sql(column: str) -> str:
    first = f"SELECT i.day, i.activity_type, i.hour_start, x.name, min([c.us, c.seq, x.at]) AS first FROM islands i JOIN classified c ON c.day = i.day AND c.hour BETWEEN i.hour_start AND i.hour_end, LATERAL (SELECT unnest(list_sort(c.{column})) AS name, unnest(range(len(c.{column}))) AS at) x GROUP BY ALL"
    return f"SELECT day, activity_type, hour_start, list(name ORDER BY first) AS {column} FROM ({first}) GROUP BY ALL"


@query(sql.over("classified", f"""{ISLANDS}, topics AS ({named_sql('topics')}), things AS ({named_sql('entities')})
    SELECT CAST(i.day AS VARCHAR) AS day, i.activity_type, i.hour_start, event_count / (hour_end - i.hour_start + 1) AS intensity, array_to_string(coalesce(topics, [])[1:5], '|') AS topics, array_to_string(coalesce(entities, [])[1:5], '|') AS entities,
      concat(i.activity_type, ' ', {hour_sql('i.hour_start')}, '-', {hour_sql('hour_end + 1')}, CASE WHEN len(topics) > 0 THEN concat(': ', array_to_string(topics[1:3], ', ')) ELSE '' END) AS label
    FROM islands i LEFT JOIN topics ON topics.day = i.day AND topics.activity_type = i.activity_type AND topics.hour_start = i.hour_start LEFT JOIN things ON things.day = i.day AND things.activity_type = i.activity_type AND things.hour_start = i.hour_start WHERE event_count >= 3"""))
def a8_cluster_intensity(spark, d):
    """Clusters of hours with what they are about."""
    e = t.classified(spark, d).withColumns({c: F.array_sort(c) for c in ("topics", "entities")})
    c = temporal.described_islands(temporal.hour_islands(e, ["day"]).where("event_count >= 3"), e, ["day"])
    return c.select(F.col("day").cast("string").alias("day"), "activity_type", "hour_start", "intensity", F.array_join("topics", "|").alias("topics"), F.array_join("entities", "|").alias("entities"), "label")


@query("SELECT event_id, event_type, CASE WHEN n = 1 THEN event_type ELSE concat(event_type, '_', n) END AS unique_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)")
def w12_numbered_ids(spark, d):
    return reports.numbered_ids(t.table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["event_id"], ["user_id"]).drop("user_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch FROM events")
def w15_batches(spark, d):
    return reports.batches(t.table(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 8).select("event_id", "batch")


@query(sql.over("classified", "WITH k AS (SELECT day, list_sort(list_distinct(list(activity_type || hour))) AS s FROM classified GROUP BY 1), n AS (SELECT day, s, lead(s) OVER (ORDER BY day) AS x FROM k) SELECT CAST(day AS VARCHAR) AS day, array_to_string(list_filter(x, lambda y: NOT list_contains(s, y)), ',') AS added, array_to_string(list_filter(s, lambda y: NOT list_contains(x, y)), ',') AS removed FROM n WHERE x IS NOT NULL"))
def j22_adjacent_diff(spark, d):
    days = t.classified(spark, d).groupBy("day").agg(F.sort_array(F.collect_set(F.concat("activity_type", F.col("hour").cast("string")))).alias("s"))
    return joins.diff_next(days, "day", "s").select(F.col("day").cast("string").alias("day"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(sql.over("prompts", "SELECT seq FROM prompts WHERE length(trim(prompt)) >= 20 AND length(trim(prompt)) <= 1500 AND NOT regexp_matches(prompt, '^#{1,3} ')"))
def f6_prompt_noise(spark, d):
    from ..sources import history as h

    return t.prompts(spark, d).where(~h.is_noise(F.trim("prompt"))).select("seq")


@query(sql.over("visits searches", "SELECT kind, count(*) AS n FROM (SELECT 'visit' AS kind FROM visits UNION ALL SELECT 'search' FROM searches) GROUP BY 1"))
def u1_union_sources(spark, d):
    return t.visits(spark, d).select(F.lit("visit").alias("kind")).unionByName(t.searches(spark, d).select(F.lit("search").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(sql.over("visits", f"SELECT minute, count(DISTINCT {sql.canonical('url')}) AS pages FROM (SELECT us // 60000000 AS minute, url FROM visits) GROUP BY 1"))
def p3_minute_buckets(spark, d):
    return t.visits(spark, d).groupBy(temporal.minute_bucket(F.col("us")).alias("minute")).agg(F.count_distinct(urls.canonical_key(F.col("url"))).alias("pages"))


