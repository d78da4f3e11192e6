"""Deduplication, top-k, set operations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls, words
from ..operators import containment, dedup, engagement, etl, joins, ordered, patterns, reports
from ..sources import driver_tables as t
from . import sql
from .registry import query

Q = sql.text
#: Rules over the made-up hosts: each kind of match, the least priority first.
RULES = ((1, "work", "ththth.example.net", "exact"), (2, "news", "blog", "prefix"), (3, "media", "m", "prefix"), (4, "research", "example.org", "suffix"), (5, "dev", "example.com", "suffix"), (6, "education", "example.net", "exact"))
RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({p}, {Q(c)}, {Q(x)}, {Q(k)})" for p, c, x, k in RULES) + ") AS r(priority, category, pattern, kind)"
SENSITIVE = ((1, "health", "example.org"), (2, "finance", "example.com/fr"), (3, "adult", "ththth.example.net"), (4, "dating", "example.net/en"))
SENSITIVE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({p}, {Q(c)}, {Q(x)})" for p, c, x in SENSITIVE) + ") AS s(priority, category, pattern)"
MATCH = "(kind = 'exact' AND (domain = pattern OR ends_with(domain, concat('.', pattern))) OR kind = 'suffix' AND ends_with(domain, concat('.', pattern)) OR kind = 'prefix' AND split_part(domain, '.', 1) = pattern)"


def rules_dim(spark):
    return spark.createDataFrame(RULES, "priority int, category string, pattern string, kind string")


def sensitive_dim(spark):
    return spark.createDataFrame(SENSITIVE, "priority int, category string, pattern string")


def best(table: str, key: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {sql.title_rank('title')} DESC, us, seq) AS n, count(*) OVER (PARTITION BY {key}) AS copies FROM {table}"


KEY = sql.canonical("url")


@query(sql.over("visits visits_dup", f"SELECT seq, us, url, copies FROM ({best('visits_dup', KEY + ', us // 60000000')}) WHERE n = 1"))
def u2_near_duplicates(spark, d):
    return dedup.collapse_near_duplicates(t.visits_dup(spark, d)).select("seq", "us", "url", "copies")


DEDUPED = f"SELECT *, row_number() OVER (PARTITION BY domain ORDER BY us DESC, seq) AS k FROM (SELECT *, {sql.host('url')} AS domain FROM ({best('visits_dup', KEY)}) WHERE n = 1)"


@query(sql.over("visits visits_dup", f"SELECT seq, us, url, domain, copies FROM ({DEDUPED}) WHERE k <= 5"))
def u3_dedup_visits(spark, d):
    return dedup.dedup_visits(t.visits_dup(spark, d), 5).select("seq", "us", "url", "domain", "copies")


@query(sql.over("visits visits_dup", f"WITH v AS (SELECT * FROM ({DEDUPED}) WHERE k <= 5), r AS ({RULES_SQL}), c AS (SELECT v.seq, any_value(v.domain) AS domain, coalesce(min_by(category, priority), 'other') AS category FROM v LEFT JOIN r ON {MATCH} GROUP BY v.seq) SELECT category, domain, count(*) AS n FROM c GROUP BY ALL"))
def top_domains_per_category(spark, d):
    """The flagship: visits, deduplicated, by category and host."""
    kept = dedup.dedup_visits(t.visits_dup(spark, d), 5)
    return joins.by_domain_rule(kept, rules_dim(spark)).groupBy(F.coalesce("category", F.lit("other")).alias("category"), "domain").agg(F.count("*").alias("n"))


@query(sql.over("prompts", "SELECT seq, key FROM (SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY us DESC, seq) AS n FROM (SELECT seq, us, trim(regexp_replace(lower(left(prompt, 60)), '\\s+', ' ', 'g')) AS key FROM prompts)) WHERE n = 1"))
def u5_prompt_dedup(spark, d):
    key = dedup.prompt_key(F.col("prompt"))
    return dedup.first_per_key(t.prompts(spark, d).withColumn("key", key), [key], [F.desc("us"), F.col("seq")]).select("seq", "key")


@query(sql.over("searches", "SELECT seq, query FROM (SELECT seq, query, row_number() OVER (PARTITION BY trim(query) ORDER BY us, seq) AS n FROM searches) WHERE n = 1"))
def u4_distinct_queries(spark, d):
    return dedup.first_per_key(t.searches(spark, d), [F.trim("query")], [F.col("us"), F.col("seq")]).select("seq", "query")


@query(sql.over("visits", f"""WITH m AS (SELECT seq, us, title, seq % 3 = 0 AND starts_with(url, 'https://') AS moved, {sql.BARE} AS url FROM visits),
    p AS (SELECT seq, url FROM m WHERE NOT moved), keys AS (SELECT DISTINCT {KEY} AS key FROM p)
    SELECT seq, url FROM p UNION ALL SELECT seq, url FROM (SELECT seq, url, row_number() OVER (PARTITION BY {KEY} ORDER BY us DESC, seq) AS n FROM m WHERE moved AND {KEY} NOT IN (SELECT key FROM keys)) WHERE n = 1"""))
def u7_follow_redirects(spark, d):
    bare = F.regexp_extract("url", "^([^?#]*)", 1)
    link = F.concat(F.lit("https://www.google.com/url?q="), F.replace(F.replace(bare, F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3A")))
    rows = t.visits(spark, d).withColumn("url", F.when((F.col("seq") % 3 == 0) & F.col("url").startswith("https://"), link).otherwise(bare))
    return dedup.follow_redirects(rows).select("seq", "url")


@query(sql.over("visits", f"SELECT domain, seq, us FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY us DESC, seq) AS n FROM (SELECT seq, us, {sql.host('url')} AS domain FROM visits)) WHERE n <= 5"))
def w1_topk_domain(spark, d):
    v = t.visits(spark, d).select("seq", "us", urls.host(F.col("url")).alias("domain"))
    return dedup.top_k(v, ["domain"], [F.desc("us"), F.col("seq")], 5).select("domain", "seq", "us")


@query(sql.over("visits", "SELECT seq, us FROM visits ORDER BY us DESC, seq LIMIT 2000"))
def o1_recent_visits(spark, d):
    return t.visits(spark, d).select("seq", "us").orderBy(F.desc("us"), "seq").limit(2000)


@query("SELECT event_id FROM events JOIN pages ON event_id % (SELECT count(*) FROM pages) = page_id WHERE (starts_with(url, 'http://') OR starts_with(url, 'https://')) AND NOT contains(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'blog') AND ts > TIMESTAMP '2024-01-05 00:00:00' AND event_id & 255 NOT IN (3, 4)")
def f1_scan_filters(spark, d):
    """Since, excluded hosts, protocol and core transition in one scan."""
    pages = t.table(spark, d, "pages")
    e = t.table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).where(~F.col("event_id").bitwiseAND(255).isin(3, 4))
    good = pages.where(urls.scheme(F.col("url")).isin("http", "https") & ~urls.host(F.col("url")).contains("blog")).select("page_id")
    return e.withColumn("page_id", F.col("event_id") % F.lit(pages.count())).join(good, "page_id").select("event_id")


@query(sql.over("visits", f"SELECT seq, domain, coalesce(category, '') AS category FROM (SELECT v.seq, any_value(domain) AS domain, min_by(category, priority) AS category FROM (SELECT seq, {sql.host('url')} AS domain FROM visits) v LEFT JOIN ({RULES_SQL}) ON {MATCH} GROUP BY v.seq)"))
def j8_domain_category(spark, d):
    v = t.visits(spark, d).select("seq", urls.host(F.col("url")).alias("domain"))
    return joins.by_domain_rule(v, rules_dim(spark)).select("seq", "domain", F.coalesce("category", F.lit("")).alias("category"))


SENSITIVE_MATCH = f"""WITH v AS MATERIALIZED (SELECT seq, url, {sql.host('url')} AS h, {sql.path('url')} AS p FROM visits), s AS (SELECT priority, category, split_part(pattern, '/', 1) AS sh, regexp_extract(pattern, '^[^/]+(/.*)?$', 1) AS sp FROM ({SENSITIVE_SQL})),
    m AS MATERIALIZED (SELECT v.seq, min_by(category, [CASE WHEN sp <> '' THEN 1 ELSE 0 END, CASE WHEN h <> sh THEN 1 ELSE 0 END, priority]) AS category FROM v JOIN s ON (h = sh OR ends_with(h, concat('.', sh))) AND starts_with(p, sp) GROUP BY v.seq)"""


@query(sql.over("visits", f"{SENSITIVE_MATCH} SELECT v.seq, v.url FROM v LEFT JOIN m USING (seq) WHERE m.category IS NULL"))
def f9_exclude_sensitive(spark, d):
    return engagement.sensitive(t.visits(spark, d), sensitive_dim(spark)).where("sensitive_category is null").select("seq", "url")


@query(sql.over("visits", f"{SENSITIVE_MATCH} SELECT v.seq, CASE WHEN m.category IS NULL THEN url ELSE concat('https://', h, '/[FILTERED]') END AS url FROM v LEFT JOIN m USING (seq)"))
def p34_redact_sensitive(spark, d):
    return engagement.redact(engagement.sensitive(t.visits(spark, d), sensitive_dim(spark))).select("seq", "url")


@query(sql.over("visits", f"{SENSITIVE_MATCH} SELECT m.category, count(*) AS n FROM v JOIN m USING (seq) GROUP BY ALL"))
def a13_sensitive_counts(spark, d):
    return engagement.sensitive(t.visits(spark, d), sensitive_dim(spark)).where("sensitive_category is not null").groupBy(F.col("sensitive_category").alias("category")).agg(F.count("*").alias("n"))


TERMS = (("the", "x"), ("ción", "x"), ("a/b", "x"))


@query(sql.over("searches", "SELECT seq FROM searches WHERE NOT contains(lower(query), 'the') AND NOT contains(lower(query), 'ción')"))
def f10_sensitive_searches(spark, d):
    dims = spark.createDataFrame(TERMS, "pattern string, category string")
    return engagement.drop_sensitive_searches(t.searches(spark, d), dims).select("seq")


BENCH_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{%d,}')) AS pattern FROM benchmark"


def bench_words(spark, d, least):
    return t.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{%d,}" % least), F.lit(0))).alias("pattern")).distinct()


@query(f"WITH p AS ({BENCH_WORDS % 4}) SELECT pattern, count(*) AS n FROM p JOIN (SELECT DISTINCT lower(text) AS text FROM documents) ON contains(text, pattern) GROUP BY ALL")
def j10_terms_in_texts(spark, d):
    """How many distinct texts contain each word of the benchmark, anywhere in them."""
    texts = t.table(spark, d, "documents").select(F.lower("text").alias("text"))
    return containment.contained(texts, bench_words(spark, d, 4)).groupBy("pattern").agg(F.count("*").alias("n"))


@query(sql.over("visits", f"WITH h AS (SELECT DISTINCT unnest(string_split({sql.host('url')}, '.')) AS domain FROM visits), p AS ({BENCH_WORDS % 5}) SELECT domain FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(domain, pattern) OR contains(pattern, domain))"))
def j12_uncovered_labels(spark, d):
    """Labels of hosts that cover, and are covered by, no word of the benchmark."""
    labels = t.visits(spark, d).select(F.explode(F.split(urls.host(F.col("url")), r"\.")).alias("domain")).distinct()
    return joins.not_covered(labels, bench_words(spark, d, 5))


@query(sql.over("visits searches", "WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(query, '[A-Za-z]{3,}')) AS entity FROM searches), t AS (SELECT DISTINCT lower(title) AS topic FROM visits) SELECT entity FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(topic, lower(entity)))"))
def j18_words_outside_titles(spark, d):
    """Words of queries that are part of no visited title."""
    names = t.searches(spark, d).select(F.explode(F.regexp_extract_all("query", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("entity")).distinct()
    return patterns.novel_entities(names, t.visits(spark, d).select(F.col("title").alias("topic")).distinct())


LINKS = "FROM searches s JOIN visits v ON v.user_id = s.user_id AND v.us >= s.us AND v.us - s.us <= 21600000000"


@query(sql.over("visits searches", f"SELECT s.seq, coalesce(n, 0) AS n_visits, CASE WHEN coalesce(n, 0) <= 2 THEN 'directed' ELSE 'undirected' END AS intent_type FROM searches s LEFT JOIN (SELECT s.seq, count(*) AS n {LINKS} GROUP BY 1) USING (seq)"))
def j4_search_visit_band(spark, d):
    """A user's visits in the six hours after a search."""
    return joins.link_searches(t.searches(spark, d), t.visits(spark, d), 360, ["user_id"]).select("seq", "n_visits", "intent_type")


@query(sql.over("visits searches", "SELECT s.seq, count(v.seq) AS n_visits, CASE WHEN count(v.seq) <= 2 THEN 'directed' ELSE 'undirected' END AS intent_type FROM searches s LEFT JOIN visits v ON v.user_id = s.user_id AND v.us >= s.us AND v.us - s.us <= 86400000000 GROUP BY 1"))
def j4_search_visit_band_by_user(spark, d):
    return joins.link_searches(t.searches(spark, d), t.visits(spark, d), 24 * 60, ["user_id"]).select("seq", "n_visits", "intent_type")


@query(sql.over("visits searches", "WITH m AS (SELECT user_id, us // 86400000000 AS mission, min(us) AS us, max(us) AS until FROM searches GROUP BY ALL) SELECT m.user_id, mission, count(*) AS n FROM m JOIN visits v ON v.user_id = m.user_id AND v.us >= m.us AND v.us <= m.until + 600000000 GROUP BY ALL"))
def j5_mission_visits(spark, d):
    missions = t.searches(spark, d).groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("mission")).agg(F.min("us").alias("us"), F.max("us").alias("until"))
    return joins.band(missions, t.visits(spark, d).select("user_id", "us"), ["user_id"], 600_000_000, "until").groupBy(F.col("l_user_id").alias("user_id"), F.col("l_mission").alias("mission")).agg(F.count("*").alias("n"))


@query(sql.over("visits searches", f"SELECT seq FROM visits SEMI JOIN (SELECT DISTINCT v.user_id, v.url {LINKS}) USING (user_id, url)"))
def j6_linked_visits(spark, d):
    v = t.visits(spark, d)
    return v.join(engagement.linked_urls(t.searches(spark, d), v, 360, ["user_id"]), ["user_id", "url"], "left_semi").select("seq")


TITLE_SQL = sql.clean_title("title")


@query(sql.over("visits searches", f"""SELECT seq, round(least(1.0, CASE WHEN len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')) >= 5 THEN 0.25 ELSE 0 END + CASE WHEN n > 1 THEN 0.20 ELSE 0 END
    + CASE WHEN linked THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(c, {Q(__import__('tallyloom.functions.rules', fromlist=['x']).TECHNICAL)}) THEN 0.15 ELSE 0 END), 6)::DOUBLE AS engagement
    FROM (SELECT seq, {TITLE_SQL} AS c, count(*) OVER (PARTITION BY user_id, url) AS n, l.url IS NOT NULL AS linked FROM visits LEFT JOIN (SELECT DISTINCT v.user_id, v.url {LINKS}) l USING (user_id, url))"""))
def p29_engagement(spark, d):
    v = t.visits(spark, d)
    return engagement.scores(v, engagement.linked_urls(t.searches(spark, d), v, 360, ["user_id"]), ["user_id"]).select("seq", F.round("engagement", 6).alias("engagement"))


RANKS = f"ranks AS (SELECT domain, row_number() OVER (ORDER BY n DESC, domain) AS rank FROM (SELECT {sql.host('url')} AS domain, count(*) AS n FROM visits GROUP BY 1))"


def ranks(spark, d):
    n = t.visits(spark, d).groupBy(urls.host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    return ordered.row_numbers(n, [F.desc("n"), "domain"], "rank").select("domain", "rank")


CANDIDATES = "candidates AS (SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN concat('sub.', h) WHEN page_id % 4 = 1 THEN concat('a-b-c-d-e.', h) WHEN page_id % 4 = 2 THEN concat('12.34.', h) ELSE h END AS domain, concat('c', page_id % 3) AS category FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS h FROM pages))"


def candidate_domains(spark, d):
    h = urls.host(F.col("url"))
    n = F.col("page_id") % 4
    made = F.when(n == 0, F.concat(F.lit("sub."), h)).when(n == 1, F.concat(F.lit("a-b-c-d-e."), h)).when(n == 2, F.concat(F.lit("12.34."), h)).otherwise(h)
    return t.table(spark, d, "pages").select(made.alias("domain"), F.concat(F.lit("c"), F.col("page_id") % 3).alias("category")).distinct()


RANKED = f"{RANKS}, {CANDIDATES}, ranked AS (SELECT c.domain, category, coalesce(a.rank, b.rank) AS rank FROM candidates c LEFT JOIN ranks a ON a.domain = c.domain LEFT JOIN ranks b ON b.domain = regexp_replace(c.domain, '^[^.]+\\.', ''))"
REASON = f"""CASE WHEN length(domain) - length(replace(domain, '-', '')) > 3 THEN 'excessive-hyphens' WHEN regexp_matches(domain, '(^|\\.)[0-9]+\\.[0-9]+(\\.|$)') THEN 'consecutive-digit-segments'
    WHEN regexp_extract(domain, '([^.]*)$', 1) IN ({', '.join(map(Q, etl.SUSPICIOUS))}) THEN 'suspicious-tld' WHEN length(regexp_extract(domain, '([^.]*)$', 1)) = 2 AND rank > 20000 THEN 'low-value-cctld' END"""


@query(sql.over("visits", f"WITH {RANKED} SELECT domain, category, coalesce(rank, 0) AS rank FROM ranked"))
def j11_rank_or_parent(spark, d):
    return joins.with_rank(candidate_domains(spark, d), ranks(spark, d)).select("domain", "category", F.coalesce("rank", F.lit(0)).alias("rank"))


@query(sql.over("visits", f"WITH {RANKED} SELECT domain, category, coalesce({REASON}, '') AS reason FROM ranked"))
def f15_quality_reason(spark, d):
    ranked = joins.with_rank(candidate_domains(spark, d), ranks(spark, d))
    return ranked.select("domain", "category", F.coalesce(etl.quality_reason(F.col("domain"), F.col("rank")), F.lit("")).alias("reason"))


@query(sql.over("visits", f"WITH {RANKED} SELECT coalesce({REASON}, 'passed') AS reason, count(*) AS n FROM ranked GROUP BY ALL"))
def a32_rejections(spark, d):
    return etl.rejections(joins.with_rank(candidate_domains(spark, d), ranks(spark, d)))


@query(sql.over("visits", f"WITH {RANKED}, good AS (SELECT * FROM ranked WHERE rank IS NOT NULL AND {REASON} IS NULL AND NOT contains(domain, 'm.') AND NOT contains('m.', domain)) SELECT category, domain, rank, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank, domain) AS n FROM good) WHERE n <= 5"))
def o6_rule_candidates(spark, d):
    """The whole offline build: rank join, quality, coverage and caps."""
    return etl.candidates(candidate_domains(spark, d), ranks(spark, d), spark.createDataFrame([("m.",)], "pattern string"), 5)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def u9_difference(spark, d):
    return t.table(spark, d, "customer").select("c_custkey").join(t.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def u8_intersection(spark, d):
    e = t.table(spark, d, "events")
    return e.where("event_type = 'signup'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT user_id, event_type AS kind FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10')")
def k5_upsert_new(spark, d):
    """Notes that exist and those that the later days add."""
    e = t.table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).alias("old"))
    return reports.upsert_new(e.where("old").select("user_id", "kind").distinct(), e.where("not old").select("user_id", "kind"), ["user_id", "kind"])


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'saved' END, o_orderpriority) AS value FROM orders LEFT JOIN customer ON o_orderkey = c_custkey UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'saved' END FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)")
def k3_merge_saved_fields(spark, d):
    made = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))
    saved = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "saved").alias("value"))
    return reports.merge_fields(made, saved, "id", "value")


@query(sql.over("visits", f"SELECT url, n FROM (SELECT {sql.host('url')} AS url, count(*) AS n FROM visits GROUP BY 1) ORDER BY n DESC, url LIMIT 8"))
def a12_top_domains(spark, d):
    return reports.top_n(t.visits(spark, d).select(urls.host(F.col("url")).alias("url")), "url", 8)


@query(sql.over("visits", f"SELECT seq, lower(title) AS title, {sql.title_rank('title')} AS rank FROM visits WHERE {sql.clean_title('title')} <> ''"))
def f3_titled_visits(spark, d):
    return t.visits(spark, d).where(words.clean_title(F.col("title")) != "").select("seq", F.lower("title").alias("title"), words.title_rank(F.col("title")).alias("rank"))
