"""Row-level queries: URLs, titles, scrubbing and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, scrub, urls, words
from ..operators import classify, patterns
from ..sources import driver_tables as t
from . import sql
from .registry import query

Q = sql.text


@query(sql.over("visits", f"SELECT seq, {sql.clean_title('title')} AS title, {sql.title_rank('title')} AS rank FROM visits"))
def p1_clean_title(spark, d):
    return t.visits(spark, d).select("seq", words.clean_title(F.col("title")).alias("title"), words.title_rank(F.col("title")).alias("rank"))


def redirect():
    return F.concat(F.lit("https://www.google.com/url?sa=t&q="), F.replace(F.replace(F.col("url"), F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3A")))



@query(sql.over("visits", f"SELECT seq, CASE WHEN starts_with(x, 'https://') THEN x ELSE '' END AS target FROM (SELECT seq, {sql.BARE} AS x FROM (SELECT seq, regexp_extract(url, '^([^&#]*)', 1) AS url FROM visits))"))
def p2_unwrap_redirect(spark, d):
    bare = t.visits(spark, d).withColumn("url", F.regexp_extract("url", "^([^?#&]*)", 1))
    return bare.select("seq", F.coalesce(urls.unwrap_redirect(redirect()), F.lit("")).alias("target"))


@query(sql.over("visits visits_dup", f"SELECT {sql.canonical('url')} AS key, count(*) AS n, count(DISTINCT url) AS urls FROM visits_dup GROUP BY 1"))
def p5_canonical_key(spark, d):
    return t.visits_dup(spark, d).groupBy(urls.canonical_key(F.col("url")).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query(sql.over("visits", f"SELECT page_id, concat(lower({sql.part('url', 1)}), '://', lower({sql.part('url', 2)}), {sql.part('url', 3)}, {sql.path('url')}) AS url FROM pages"))
def p6_sanitize_url(spark, d):
    return t.table(spark, d, "pages").select("page_id", urls.sanitize(F.col("url")).alias("url"))


@query(f"SELECT doc_id, {sql.scrubbed('text')} AS text FROM documents")
def p7_scrub_documents(spark, d):
    return t.table(spark, d, "documents").select("doc_id", scrub.secrets(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {sql.personal('text')} AS text FROM documents")
def p8_scrub_personal(spark, d):
    return t.table(spark, d, "documents").select("doc_id", scrub.emails(scrub.home_paths(scrub.ips(F.col("text")))).alias("text"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\n{3,}', '\\n\\n', 'g'), '<turn_aborted\\s*/?>', '', 'g')) AS text FROM conversations".replace("'\\n\\n'", "chr(10) || chr(10)"))
def p9_markup_artifacts(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", scrub.markup_artifacts(F.col("text")).alias("text"))


@query(sql.over("visits", f"SELECT seq, {sql.scrubbed('url')} AS url, {sql.personal(sql.scrubbed('title'))} AS title FROM (SELECT seq, title, concat(lower({sql.part('url', 1)}), '://', lower({sql.part('url', 2)}), {sql.part('url', 3)}, {sql.path('url')}) AS url FROM visits)"))
def p10_sanitize_visits(spark, d):
    return t.visits(spark, d).select("seq", scrub.secrets(urls.sanitize(F.col("url"))).alias("url"), scrub.text(F.col("title")).alias("title"))


def category():
    return F.element_at(F.array(*map(F.lit, (*rules.ACTIVITIES, "design"))), (F.col("seq") % (len(rules.ACTIVITIES) + 1) + 1).cast("int"))


CATEGORY_SQL = f"[{', '.join(map(Q, (*rules.ACTIVITIES, 'design')))}][seq % {len(rules.ACTIVITIES) + 1} + 1]"


@query(sql.over("visits", f"SELECT seq, concat({sql.host('url')}, ' - ', left(title, 80)) AS text, {CATEGORY_SQL} AS category, {sql.lookup(CATEGORY_SQL, rules.ACTIVITIES, Q('unknown'))} AS activity_type, {sql.lookup(CATEGORY_SQL, rules.CATEGORY_SUMMARIES, Q('Browsing web content'))} AS summary, {sql.first_match('concat(' + sql.host('url') + ', ' + Q(' - ') + ', left(title, 80))', rules.INTENTS, Q('explore'))} AS intent FROM visits"))
def p12_classify_visits(spark, d):
    return classify.by_rules(classify.raw_visits(t.visits(spark, d).withColumn("category", category()))).select("seq", "text", "category", "activity_type", "summary", "intent")


@query(sql.over("prompts", f"SELECT seq, {sql.task_type('left(prompt, 150)')} AS task_type, {sql.prompt_topic('left(prompt, 150)', Q(''))} AS topic FROM prompts"))
def p13_task_type_and_topic(spark, d):
    text = F.substring("prompt", 1, 150)
    return t.prompts(spark, d).select("seq", rules.task_type(text).alias("task_type"), rules.prompt_topic(text, "").alias("topic"))


@query(sql.over("searches", f"SELECT seq, {sql.first_match('query', rules.SEARCH_TOPICS, Q('information'))} AS topic, {sql.first_match('query', rules.INTENTS, Q('explore'))} AS intent, {sql.first_match('query', rules.QUERY_INTENTS, Q('transactional'))} AS query_intent FROM searches"))
def p15_search_topic_and_intent(spark, d):
    q = F.col("query")
    return t.searches(spark, d).select("seq", rules.search_topic(q).alias("topic"), rules.intent(q, F.lit("search")).alias("intent"), rules.query_intent(q).alias("query_intent"))


SITE = "regexp_split_to_array(regexp_replace(h, '\\.[A-Za-z0-9_]{2,4}$', ''), '\\.')[-1]"


@query(sql.over("visits", f"""SELECT seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], '|') AS entities FROM (
    SELECT seq, list_concat(CASE WHEN length({SITE}) > 2 THEN [concat(upper(left({SITE}, 1)), substr({SITE}, 2))] ELSE [] END,
      list_filter(regexp_extract_all(title, '\\b[A-Z][a-zA-Z0-9]+(?:\\.[a-zA-Z]+)?\\b'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(Q, rules.ENTITY_STOPWORDS))})),
      list_filter(regexp_extract_all(title, '\\b[a-z]+-[a-z]+(?:-[a-z]+)?\\b'), lambda w: length(w) > 4)) AS l FROM (SELECT seq, title, {sql.host('url')} AS h FROM visits))"""))
def p17_entities(spark, d):
    return t.visits(spark, d).select("seq", F.array_join(rules.entities(F.col("title"), urls.host(F.col("url"))), "|").alias("entities"))


#: Topics as people write them, made from titles: some are chatter, some names.
def raw_topic():
    return F.concat(F.element_at(F.array(*map(F.lit, ("the ", "My ", "these last ", "", "site.", "a/"))), (F.col("seq") % 6 + 1).cast("int")), F.substring_index(F.col("title"), " ", 3))

LEAD = "|".join(words.LEADING_NOISE)


@query(sql.over("visits", f"""WITH r AS (SELECT seq, concat(['the ', 'My ', 'these last ', '', 'site.', 'a/'][seq % 6 + 1], array_to_string(string_split(title, ' ')[1:3], ' ')) AS t FROM visits),
    c AS (SELECT seq, CASE WHEN NOT contains(t, '.') AND NOT regexp_matches(t, '[/\\\\?=&]') AND NOT (regexp_matches(t, '^[A-Z]\\S*(\\s+[A-Z]\\S*)+$') AND regexp_matches(t, '(^|\\s)[A-Z][a-z]'))
      THEN regexp_replace(trim(t), '^(?i)((({LEAD})(\\s+|$))*)', '') END AS c FROM r)
    SELECT seq, coalesce(CASE WHEN length(c) >= 2 AND len(list_filter(regexp_split_to_array(lower(c), '\\s+'), lambda w: w IN ({', '.join(map(Q, words.TOPIC_STOPWORDS))}))) / len(list_filter(regexp_split_to_array(lower(c), '\\s+'), lambda w: w <> '')) < 0.5 THEN c END, '') AS topic FROM c"""))
def p19_filter_topics(spark, d):
    return t.visits(spark, d).select("seq", F.array_join(words.keep_topics(F.array(raw_topic())), "|").alias("topic"))


@query(sql.over("classified", f"SELECT seq, CASE WHEN {CATEGORY_SQL} IN ({', '.join(map(Q, rules.ENTITY_CATEGORIES))}) THEN len(topics) ELSE 0 END AS n_topics FROM classified"))
def p20_entity_gating(spark, d):
    return classify.gated(t.classified(spark, d).withColumn("category", category())).select("seq", F.size("topics").alias("n_topics"))


@query(sql.over("commits", f"SELECT seq, {sql.commit('message', 1)} AS type, {sql.commit('message', 2)} AS scope, {sql.commit('message', 3)} = '!' AS breaking, {sql.description('message')} AS description, {sql.work_mode('message')} AS work_mode FROM commits"))
def p21_commit_work_mode(spark, d):
    m = F.col("message")
    return t.commits(spark, d).select("seq", rules.commit_type(m).alias("type"), F.coalesce(rules.commit_scope(m), F.lit("")).alias("scope"), rules.commit_breaking(m).alias("breaking"), rules.commit_description(m).alias("description"), rules.work_mode(m, F.col("insertions"), F.col("deletions")).alias("work_mode"))


WHY_SQL = [rf"(?i)\b({p}\b)" if i != 1 else r"(?i)\b(so\s+[A-Za-z0-9_])" for i, p in enumerate(rules.WHY)]


@query(sql.over("commits", f"SELECT seq, coalesce({', '.join(f'CASE WHEN regexp_matches(message, {Q(p)}) THEN trim(substr(message, strpos(message, regexp_extract(message, {Q(p)}, 1)), 120)) END' for p in WHY_SQL)}, '') AS why, regexp_matches(trim(message), {Q(rules.GENERIC)}) AS is_generic FROM commits"))
def p23_why_and_generic(spark, d):
    return t.commits(spark, d).select("seq", F.coalesce(rules.why_clause(F.col("message")), F.lit("")).alias("why"), rules.is_generic(F.col("message")).alias("is_generic"))


V1 = r"(?i)^(fix|debug|add|create|build|implement|write|refactor|update|review|explain|help\s+me\s+(with|understand)|how\s+do\s+i)\s+"
V2 = r"(?i)^(what\s+is|what\s+are|why\s+(does|is|isn't|isnt)|how\s+does)\s+"


@query(sql.over("prompts", f"SELECT seq, trim(CASE WHEN regexp_matches(x, '^[^?.!]+[?.!]') THEN regexp_extract(x, '^([^?.!]+)[?.!]', 1) ELSE left(x, 80) END) AS title FROM (SELECT seq, regexp_replace(regexp_replace(left(prompt, 200), {Q(V1)}, ''), {Q(V2)}, '') AS x FROM prompts)"))
def p24_task_title(spark, d):
    return t.prompts(spark, d).select("seq", rules.task_title(F.col("prompt")).alias("title"))


@query(sql.over("prompts", f"SELECT task_type, CASE WHEN task_type IN ('learning', 'architecture') THEN 'exploration' ELSE 'acceleration' END AS mode, count(*) AS n FROM (SELECT {sql.task_type('prompt')} AS task_type FROM prompts) GROUP BY ALL"))
def p25_interaction_modes(spark, d):
    kind = rules.task_type(F.col("prompt"))
    return t.prompts(spark, d).groupBy(kind.alias("task_type"), rules.interaction_mode(kind).alias("mode")).agg(F.count("*").alias("n"))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({sql.tokens('text')})), ' ') AS words, CAST(len({sql.tokens('text')}) AS INTEGER) AS n FROM benchmark")
def p27_content_words(spark, d):
    return t.table(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(words.content_words(F.col("text"))), " ").alias("words"), F.size(words.tokens(F.col("text"))).alias("n"))


@query("SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 17 THEN 'Afternoon' ELSE 'Evening' END AS period, CASE WHEN hour(ts) = 0 THEN '12am' WHEN hour(ts) < 12 THEN concat(hour(ts), 'am') WHEN hour(ts) = 12 THEN '12pm' ELSE concat(hour(ts) - 12, 'pm') END AS label, strftime(ts, '%G-W%V') AS week FROM events")
def p30_time_labels(spark, d):
    h = F.hour("ts")
    return t.table(spark, d, "events").select("event_id", words.period(h).alias("period"), words.hour_label(h).alias("label"), words.iso_week(F.to_date("ts")).alias("week"))


TIMELINE = "visits searches prompts commits"


@query(sql.over(TIMELINE, f"""SELECT us, source, left(detail, 60) AS detail FROM (
    SELECT us, 'browser' AS source, {sql.clean_title('title')} AS detail FROM visits UNION ALL SELECT us, 'search', query FROM searches
    UNION ALL SELECT us, 'claude', prompt FROM prompts UNION ALL SELECT us, 'git', concat(repo, ': ', message) FROM commits)"""))
def p31_unified_timeline(spark, d):
    one = lambda df, source, detail: df.where("us is not null").select("us", F.lit(source).alias("source"), F.substring(detail, 1, 60).alias("detail"))
    rows = one(t.visits(spark, d), "browser", words.clean_title(F.col("title"))).unionByName(one(t.searches(spark, d), "search", F.col("query")))
    return rows.unionByName(one(t.prompts(spark, d), "claude", F.col("prompt"))).unionByName(one(t.commits(spark, d), "git", F.concat("repo", F.lit(": "), "message")))


KEPT = f"list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({', '.join(map(Q, urls.TRACKING))}))"


LAST = "CASE WHEN contains(left(u, 41), '{m}') THEN length(left(u, 41)) - instr(reverse(left(u, 41)), '{m}') END"
CUT = "coalesce(" + ", ".join(f"CASE WHEN {LAST.format(m=m)} > 30 THEN {LAST.format(m=m)} END" for m in "?&/") + ", 40)"


@query(f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'x.hubspotlinks.com [HubSpot tracking link]' WHEN 1 THEN 'bit.ly [bit.ly short link]' WHEN 2 THEN 'url12.mimecastprotect.com [Mimecast link]'
    ELSE CASE WHEN length(u) > 40 THEN concat(left(u, {CUT}), '…') ELSE u END END AS url FROM (SELECT page_id, concat({sql.BARE}, CASE WHEN len({KEPT}) > 0 THEN concat('?', array_to_string({KEPT}, '&')) ELSE '' END) AS u FROM pages)""")
def p32_display_url(spark, d):
    n, tail = F.col("page_id") % 9, F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1)
    url = F.when(n == 0, F.concat(F.lit("https://X.hubspotlinks.com"), tail)).when(n == 1, F.concat(F.lit("http://bit.ly"), tail)).when(n == 2, F.concat(F.lit("https://url12.mimecastprotect.com"), tail)).otherwise(F.col("url"))
    return t.table(spark, d, "pages").select("page_id", urls.display(url, 40).alias("url"))


MARKED = "replace(regexp_replace(replace(replace(x, '<', '&lt;'), '>', '&gt;'), '(^|[\\s(\\[])#([A-Za-z])', '\\1\\\\#\\2', 'g'), '::', concat(':', chr(8203), ':'))"


@query(f"""SELECT doc_id, {MARKED} AS item, regexp_replace({MARKED}, '([\\[\\]])', '\\\\\\1', 'g') AS link_text, replace({MARKED}, '|', '\\|') AS cell, regexp_replace(x, '[*_`\\[\\]]', '', 'g') AS inline,
    CASE WHEN regexp_matches(x, '[:{{}}\\[\\]#&*!|>''"%@`,?\\r\\n]') OR contains(x, '---') THEN concat('"', replace(x, '"', '\\"'), '"') ELSE x END AS yaml
    FROM (SELECT doc_id, concat('#tag ', coalesce(text, ''), ' (#b) [x]|y::z') AS x FROM documents)""")
def scalar_markdown_escapes(spark, d):
    x = F.concat(F.lit("#tag "), F.coalesce("text", F.lit("")), F.lit(" (#b) [x]|y::z"))
    rows = t.table(spark, d, "documents").select("doc_id", x.alias("x"))
    c = F.col("x")
    return rows.select("doc_id", words.escape_markdown(c).alias("item"), words.escape_link_text(c).alias("link_text"), words.escape_table_cell(c).alias("cell"), words.escape_inline(c).alias("inline"), words.quote_yaml(c).alias("yaml"))


@query("SELECT item_id, CASE WHEN s = '' THEN 'topic' ELSE s END AS slug, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM (SELECT item_id, text, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS s FROM benchmark)")
def scalar_slugs(spark, d):
    return t.table(spark, d, "benchmark").select("item_id", words.slug(F.col("text"), 60, "topic").alias("slug"), words.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, replace(replace(replace(html, '\\', '\\\\'), '|', '\\|'), chr(10), ' ') AS cell, regexp_replace(html, '[\\[\\]|#^]', '', 'g') AS link, replace(replace(html, '\\', '\\\\'), '\"', '\\\"') AS yaml FROM pages")
def scalar_escapes(spark, d):
    x = F.col("html")
    return t.table(spark, d, "pages").select("page_id", words.escape_html(x).alias("html"), words.escape_cell(x).alias("cell"), words.escape_wikilink(x).alias("link"), words.escape_yaml(x).alias("yaml"))


@query(sql.over("classified", "SELECT a, b, count(*) AS n, count(DISTINCT activity_type) AS contexts FROM (SELECT activity_type, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT activity_type, entities, unnest(entities) AS x FROM classified), unnest(entities) AS u(y) WHERE x < y) GROUP BY ALL HAVING count(*) >= 3 AND NOT bool_and(activity_type = 'unknown')"))
def a10_entity_relations(spark, d):
    return patterns.entity_relations(t.classified(spark, d), top=None).select("a", "b", "n", F.size("contexts").cast("long").alias("contexts"))
