"""SQL fragments that the oracles share: the logical tables and column expressions."""

from __future__ import annotations

from ..functions import rules, scrub, urls, words
from ..sources import driver_tables


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PARTS = text(urls.PARTS)


def part(url: str, group: int) -> str:
    return f"regexp_extract(coalesce({url}, ''), {PARTS}, {group})"


def host(url: str) -> str:
    return f"regexp_replace(lower({part(url, 2)}), '^www\\.', '')"


def path(url: str) -> str:
    return f"CASE WHEN {part(url, 4)} = '' THEN '/' ELSE {part(url, 4)} END"


def canonical(url: str) -> str:
    p, h = path(url), host(url)
    plain = f"regexp_replace({p}, '/+$', '')"
    maps = f"{h} IN ('maps.google.com', 'google.com') AND starts_with({p}, '/maps/')"
    return f"CASE WHEN {part(url, 2)} <> '' THEN concat('https://', {h}, CASE WHEN {maps} THEN split_part({p}, '/@', 1) WHEN {plain} = '' THEN '/' ELSE {plain} END) ELSE {url} END"


def clean_title(t: str) -> str:
    bare = f"CASE {' '.join(f'WHEN ends_with({t}, {text(b)}) THEN trim(left({t}, length({t}) - {len(b)}))' for b in words.BRANDS)} ELSE coalesce({t}, '') END"
    parts = f"list_transform(regexp_split_to_array({bare}, {text(words.SEPARATORS)}), lambda x: trim(x))"
    longest = f"coalesce(list_filter({parts}, lambda x: length(x) = list_max(list_transform({parts}, lambda y: length(y))))[1], '')"
    return f"CASE WHEN {longest} IN ({', '.join(map(text, words.NOISE_TITLES))}) OR length({longest}) < 5 THEN '' ELSE {longest} END"


def title_rank(t: str) -> str:
    return f"CASE WHEN length({clean_title(t)}) > 0 THEN length({clean_title(t)}) ELSE length(coalesce({t}, '')) END"


def first_match(t: str, table, default: str) -> str:
    return f"CASE {' '.join(f'WHEN regexp_matches({t}, {text(p)}) THEN {text(x)}' for p, x in table)} ELSE {default} END"


def lookup(t: str, table: dict[str, str], default: str) -> str:
    return f"CASE {t} {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in table.items())} ELSE {default} END"


def tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(text, words.QUERY_STOPWORDS))}))"


def scrubbed(t: str) -> str:
    """The secret rules; word boundaries become captured neighbours, so those rules run twice."""
    for p, r in scrub.SECRETS:
        bounded = p.startswith(scrub.B)
        p = p.replace(scrub.B, "(^|[^A-Za-z0-9_])(?:").replace(scrub.E, ")([^A-Za-z0-9_]|$)")
        r = rf"\1{r}\2" if bounded else r.replace("$", "\\")
        for _ in range(1 + bounded):
            t = f"regexp_replace({t}, {text(p)}, {text(r)}, 'g')"
    return t


def personal(t: str) -> str:
    ip = scrub.IP.replace(scrub.B, "(^|[^A-Za-z0-9_])(?:").replace(scrub.E, ")([^A-Za-z0-9_]|$)")
    for _ in range(2):
        t = f"regexp_replace({t}, {text(ip)}, '\\1[IP_REDACTED]\\2', 'g')"
    return f"regexp_replace(regexp_replace({t}, {text(scrub.HOME)}, '~', 'g'), {text(scrub.EMAIL)}, '[EMAIL]', 'g')"


def work_mode(m: str) -> str:
    kind, desc = commit(m, 1), description(m)
    t = f"concat({desc}, ' ', {m})"
    by_size = "CASE WHEN insertions > 0 AND deletions = 0 THEN 'building' WHEN deletions > 0 AND insertions = 0 THEN 'restructuring' WHEN insertions + deletions > 0 AND insertions / greatest(deletions, 1) > 3 THEN 'building' WHEN insertions + deletions > 0 AND insertions / greatest(deletions, 1) < 0.33 THEN 'restructuring' ELSE 'tweaking' END"
    return f"coalesce({lookup(kind, rules.WORK_MODES, 'NULL')}, {first_match(t, rules.MODE_WORDS, by_size)})"


def commit(m: str, group: int) -> str:
    x = f"regexp_extract(trim({m}), {text(rules.COMMIT)}, {group})"
    return f"lower({x})" if group == 1 else x


def description(m: str) -> str:
    return f"CASE WHEN {commit(m, 1)} <> '' THEN trim({commit(m, 4)}) ELSE trim({m}) END"


def prompt_topic(t: str, default: str) -> str:
    found = f"list_filter(regexp_split_to_array(regexp_replace({t}, '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3)[1:3]"
    return first_match(t, rules.PROMPT_TOPICS, f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, ' ') ELSE {default} END")


def task_type(t: str) -> str:
    return first_match(f"left({t}, 200)", rules.TASK_TYPES, "'implementation'")


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
BARE = "regexp_extract(url, '^([^?#]*)', 1)"
PREFIXES = "[" + ", ".join(map(text, driver_tables.PREFIXES)) + "]"

#: The logical tables, as common table expressions.
TABLES = {
    "visits": f"SELECT event_id AS seq, user_id, epoch_us(ts) AS us, url, {TITLE} AS title FROM events JOIN pages ON event_id % (SELECT greatest(1, count(*)) FROM pages) = page_id WHERE event_type IN ('view', 'click')",
    "visits_dup": f"""SELECT seq * 5 + variant AS seq, user_id, us + late AS us, u AS url, title FROM (
        SELECT *, 0 AS variant, url AS u, 0 AS late FROM visits UNION ALL SELECT *, 1, concat({BARE}, '?v=1'), 0 FROM visits UNION ALL SELECT *, 2, concat({BARE}, '#x'), 0 FROM visits
        UNION ALL SELECT *, 3, regexp_replace(url, '^([a-z]+://)', '\\1www.'), 0 FROM visits UNION ALL SELECT *, 4, url, 20000000 FROM visits)""",
    "searches": "SELECT event_id AS seq, user_id, epoch_us(ts) AS us, text AS query, 'google.com' AS engine FROM events JOIN benchmark ON event_id % (SELECT greatest(1, count(*)) FROM benchmark) = item_id WHERE event_type = 'signup'",
    "prompts": f"SELECT conv_id * 1000 + turn AS seq, {driver_tables.EPOCH_US} + conv_id * 3600000000 + turn * 300000000 AS us, text AS prompt, conv_id AS conversation, concat('project', conv_id % 7) AS project FROM conversations WHERE role = 'user'",
    "commits": f"""SELECT event_id AS seq, user_id, epoch_us(ts) AS us, p_brand AS repo, CASE WHEN p = 'wip' THEN p ELSE concat(p, lower(p_type)) END AS message, CAST(floor(value) AS BIGINT) AS insertions, CAST(floor(value / 7) AS BIGINT) AS deletions
        FROM (SELECT *, {PREFIXES}[event_id % {len(driver_tables.PREFIXES)} + 1] AS p FROM events WHERE event_type = 'purchase') e JOIN part ON event_id % (SELECT count(*) FROM part) + (SELECT min(p_partkey) FROM part) = p_partkey""",
    "classified": """SELECT event_id AS seq, user_id, epoch_us(ts) AS us, hour(ts) AS hour, CAST(ts AS DATE) AS day, event_type AS activity_type, k,
        list_distinct([concat('topic', k % 9), concat('topic', event_id % 9)]) AS topics, list_distinct([concat('Tool', k % 13), concat('Tool', event_id % 31 % 13), concat('Tool', user_id % 13)]) AS entities
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""",
}


def over(tables: str, query: str, recursive: bool = False) -> str:
    """The query with the named tables in front, in their order."""
    named = ", ".join(f"{t} AS MATERIALIZED ({TABLES[t]})" for t in tables.split())
    rest = query.lstrip()
    if rest.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{named}, {rest[5:]}"
    return f"WITH {named} {rest}"
