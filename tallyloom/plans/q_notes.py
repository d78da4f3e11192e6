"""Notes, answers and artifacts; the SQL puts expected texts together from their parts instead of taking notes apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts, notes
from ..sources import driver_tables as t
from . import sql
from .registry import query

#: Of each conversation the first and the last text, in one line each, and how many turns it has.
TALKS = """WITH one AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
    talks AS (SELECT conv_id, min_by(x, turn) AS a, max_by(x, turn) AS z, count(*) AS n FROM one GROUP BY conv_id)"""
HEAD, QUESTION, FOOT = "# Day\n\n## Searches\n\n- ", "> What was it?\n---\nreflect_main:: ", "\n---\n\n*Generated*\n"
LONG = 200


def talks(spark, d):
    x = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = t.table(spark, d, "conversations").select("conv_id", "turn", x.alias("x")).where("x <> ''")
    return rows.groupBy("conv_id").agg(F.min_by("x", "turn").alias("a"), F.max_by("x", "turn").alias("z"), F.count("*").alias("n"))


def note_tables(spark, d):
    """Generated and existing notes. Those of long first texts have no place for notes; those of one turn were written by hand."""
    rows, n = talks(spark, d), F.col("n").cast("string")
    place = F.when(F.length("a") > LONG, "").otherwise("\n\n## Notes\n\n" + notes.PLACEHOLDER)
    new = rows.select(F.col("conv_id").alias("note_id"), F.concat(F.lit(HEAD), n, place, F.lit(f"\n\n## Reflection\n\n{QUESTION}\nreflect_other:: \n{FOOT}")).alias("text"))
    full = F.concat(F.lit(HEAD + "old\n\n## Notes\n\n"), "a", F.lit("\n\n## \U0001f9ea My lab\n\n"), "z", F.lit("\nmore\n\n## Reflection\n\n" + QUESTION), "z", F.lit(f"\n\n{FOOT}"))
    return new, rows.select(F.col("conv_id").alias("note_id"), F.when(F.col("n") == 1, F.concat(F.lit("By hand\n\n## Own\n"), "a")).otherwise(full).alias("text"))


def q(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def lit(x: str) -> str:
    return "concat(" + ", chr(10), ".join(sql.text(p) for p in x.split("\n")) + ", '')"


MERGED = f"""{TALKS}, parts AS (SELECT *, length(a) > {LONG} AS nowhere, {q(lit(HEAD), 'n')} AS head,
    CASE WHEN length(a) > {LONG} THEN '' ELSE {q(lit(chr(10) * 2 + '## Notes' + chr(10) * 2), "'%s'")} END AS place FROM talks)
    SELECT conv_id AS note_id, CASE WHEN n = 1
      THEN {q('head', f"replace(place, '%s', {lit(notes.PLACEHOLDER)})", lit(chr(10) * 2 + '## Reflection' + chr(10) * 2 + QUESTION + chr(10) + 'reflect_other:: ' + chr(10)), lit(notes.FOOTER + chr(10) + '## ' + notes.PRESERVED + chr(10) * 2 + notes.NOTICE), lit('By hand' + chr(10) * 2 + '## Own' + chr(10)), 'a', lit(chr(10)), lit(FOOT))}
      ELSE {q('head', "replace(place, '%s', a)", lit(chr(10) * 2 + '## Reflection' + chr(10) * 2 + QUESTION), 'z', lit(chr(10) + 'reflect_other:: ' + chr(10)), lit(chr(10) * 2), f"CASE WHEN nowhere THEN {q(lit('## Notes' + chr(10) * 2), 'a', lit(chr(10) * 2))} ELSE '' END", lit('## ' + chr(0x1F9EA) + ' My lab' + chr(10) * 2), 'z', lit(chr(10) + 'more' + chr(10)), lit(FOOT))} END AS text FROM parts"""


@query(MERGED)
def k2_merged_notes(spark, d):
    """Notes that are made anew, with what users wrote in the old ones."""
    return notes.merged(*note_tables(spark, d))


@query(f"{TALKS} SELECT concat(conv_id, '.2024-05-01T00-00-00.bak.md') AS name, length(a) > 0 AS kept FROM talks")
def k4_backups(spark, d):
    """Every existing note above has something of its user's, so each is kept before it is merged; a note as generated is not."""
    new, old = note_tables(spark, d)
    both = old.unionByName(new.select((-1 - F.col("note_id")).alias("note_id"), "text"))
    return notes.backups(both, "2024-05-01T00-00-00").select("name", (F.length("text") > 0).alias("kept"))


@query(sql.over("visits searches prompts commits", """WITH n AS (SELECT us // 86400000000 AS day, count(*) FILTER (s = 'v') AS visits, count(*) FILTER (s = 's') AS searches, count(*) FILTER (s = 'p') AS prompts, count(*) FILTER (s = 'c') AS commits
    FROM (SELECT us, 'v' AS s FROM visits UNION ALL SELECT us, 's' FROM searches UNION ALL SELECT us, 'p' FROM prompts UNION ALL SELECT us, 'c' FROM commits) GROUP BY 1)
    SELECT day AS note_id, CASE WHEN visits > 0 THEN visits ELSE 0 END AS visits, CASE WHEN visits > 0 THEN searches ELSE 0 END AS searches, CASE WHEN visits > 0 THEN prompts ELSE 0 END AS prompts, CASE WHEN visits > 0 THEN commits ELSE 0 END AS commits,
      CASE WHEN commits > 0 THEN 'local-model' END AS model, CASE WHEN commits > 0 THEN visits * 3 END AS tokens, CASE WHEN commits > 0 THEN 'browser_activity,git' ELSE '' END AS prompt_sections, concat('Searches', ',', 'Notes') AS headings, concat(visits + 1, '%') AS focus FROM n"""))
def s18_note_facts(spark, d):
    """A note for each day with its counts, read back: days without visits have no line of counts, those without commits no prompt."""
    rows = None
    for name, frame in (("visits", t.visits), ("searches", t.searches), ("prompts", t.prompts), ("commits", t.commits)):
        part = frame(spark, d).select(F.floor(F.col("us") / 86_400_000_000).alias("note_id"), F.lit(name).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    n = rows.groupBy("note_id").agg(*[F.count_if(F.col("s") == x).cast("string").alias(x) for x in ("visits", "searches", "prompts", "commits")])
    stats = F.when(F.col("visits") != "0", F.concat(F.lit("> [!info] "), "visits", F.lit(" visits · "), "searches", F.lit(" searches · "), "prompts", F.lit(" AI prompts · "), "commits", F.lit(" commits · 3 categories\n"))).otherwise("")
    prompt = F.concat(F.lit("<details>\n<summary>Prompt sent to local-model · "), (F.col("visits").cast("long") * 3).cast("string"), F.lit(" tokens · Tier 2</summary>\n<pre>\n<browser_activity>\nx\n</browser_activity>\n<git>y</git>\n</pre>\n</details>\n"))
    text = F.concat(F.lit("---\nfocus_score: 0%\ntags: [a, b]\nfocus_score: "), (F.col("visits").cast("long") + 1).cast("string"), F.lit("%\n---\n"), stats, F.lit("\n## Searches\n- a\n"), F.when(F.col("commits") != "0", prompt).otherwise(""), F.lit("\n##  Notes \n"))
    out = notes.facts(n.select("note_id", text.alias("text")))
    return out.select("note_id", "visits", "searches", "prompts", "commits", "model", "tokens", F.array_join("prompt_sections", ",").alias("prompt_sections"), F.array_join("headings", ",").alias("headings"), F.element_at("front", "focus_score").alias("focus"))


#: An answer of each conversation: a headline, its texts as a list with lines that go on, and its texts tagged by their first letter.
WORDS = "SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"


def answers(spark, d):
    x = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = t.table(spark, d, "conversations").select("conv_id", "turn", "role", x.alias("x")).where("x <> ''")
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", c.alias("y")))), lambda r: r.y), "\n")
    item = F.concat(F.when(F.col("role") == "user", "- ").otherwise("  \n  "), "x")
    tag = F.concat(F.lit("* **"), "role", F.lit("**:  "), "x", F.lit("?"))
    talk = rows.groupBy("conv_id").agg(F.min_by("x", "turn").alias("a"), ordered(item).alias("items"), ordered(tag).alias("tags"))
    text = F.concat(F.lit("Sure.\n## Headline\n\nold\n\n## Learnings\n\n"), "items", F.lit("\n\n##  Reflections\n"), "tags", F.lit("\n- no tag\n\n## HEADLINE\n"), "a", F.lit("\n\n## Empty\n\n"))
    return notes.answer_sections(talk.select(F.col("conv_id").alias("note_id"), text.alias("text")))


@query(f"WITH w AS ({WORDS}) SELECT conv_id AS note_id, 'headline' AS heading, min_by(x, turn) AS content FROM w GROUP BY 1")
def prose_headlines(spark, d):
    return answers(spark, d).where("heading not in ('learnings', 'reflections')")


@query(f"""WITH w AS ({WORDS}), k AS (SELECT *, greatest(1, count(*) FILTER (role = 'user') OVER o + CASE WHEN first_value(role) OVER o <> 'user' THEN 1 ELSE 0 END) AS n FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id AS note_id, 'learnings' AS heading, n, string_agg(x, ' ' ORDER BY turn) AS item FROM k GROUP BY ALL""")
def prose_lists(spark, d):
    """The items of lists, with the lines that go on."""
    return notes.bullet_items(answers(spark, d).where("heading = 'learnings'"))


@query(f"""WITH w AS ({WORDS}), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM w)
    SELECT conv_id AS note_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN r = 1 THEN role ELSE concat(role, '_', r) END AS id, concat(x, '?') AS question FROM k""")
def prose_reflections(spark, d):
    """Tagged reflections; of equal tags the next are numbered."""
    return notes.reflections(answers(spark, d))


@query(sql.over("classified", """WITH m AS (SELECT 'topic' AS kind, unnest(topics) AS name, day FROM classified UNION ALL SELECT 'entity', unnest(entities), day FROM classified UNION ALL SELECT 'seed', activity_type, day FROM classified)
    SELECT concat(kind, 's/', lower(name), '.md') AS path, CASE WHEN kind = 'seed'
      THEN concat('---', chr(10), 'type: seed', chr(10), 'created: ', min(day), chr(10), 'source: "[[daily/', min(day), ']]"', chr(10), 'status: stub', chr(10), '---', chr(10), chr(10), '# ', name, chr(10), chr(10), '> Seeded from [[daily/', min(day), ']] on ', min(day), '. Expand this note.', chr(10), chr(10), '## Notes', chr(10), chr(10))
      ELSE concat('---', chr(10), 'type: ', kind, chr(10), 'created: ', min(day), chr(10), '---', chr(10), chr(10), '# ', name, chr(10), chr(10), '## Appearances', chr(10), chr(10), (SELECT string_agg(concat('- [[daily/', d, ']] — ', d), chr(10) ORDER BY d) FROM (SELECT unnest(list(DISTINCT day)) AS d)), chr(10)) END AS text
    FROM m GROUP BY kind, name"""))
def k5_linked_artifacts(spark, d):
    """Notes of topics, entities and seeds, made by merging the table of all days into one that has the earlier half, twice."""
    e = t.classified(spark, d)
    named = lambda c: e.select(F.explode(c).alias("name"), "day")

    def found(cut=None):
        parts = ((named("topics"), "topic"), (named("entities"), "entity"), (e.select(F.col("activity_type").alias("name"), "day"), "seed"))
        out = [artifacts.of_mentions(m if cut is None else m.where(F.col("day") <= cut), F.lower("name"), kind) for m, kind in parts]
        return out[0].unionByName(out[1]).unionByName(out[2])

    first, last = e.agg(F.min("day"), F.max("day")).first()
    half = None if first is None else first + (last - first) / 2
    once = artifacts.merged(found(F.lit(half).cast("date")), found())
    return artifacts.rendered(artifacts.merged(once, found()))


@query(sql.over("classified", """WITH m AS (SELECT day, 'topic' || k % 9 AS topic, count(*) AS n FROM (SELECT day, k FROM classified) GROUP BY ALL), top AS (SELECT day, list(topic ORDER BY n DESC, topic)[1:10] AS topics FROM m GROUP BY day),
    w AS (SELECT concat(isoyear(day), '-W', lpad(weekofyear(day)::VARCHAR, 2, '0')) AS slug, day, concat('- [[daily/', day, ']] — ', day, ' · Topics: ', array_to_string(list_transform(topics, lambda x: concat('[[', x, ']]')), ', ')) AS line FROM top)
    SELECT concat('weeks/', slug, '.md') AS path, concat('---', chr(10), 'type: moc', chr(10), 'week: ', slug, chr(10), 'created: ', min(day), chr(10), '---', chr(10), chr(10), '# Week ', slug, chr(10), chr(10), '## Daily Notes', chr(10), chr(10), string_agg(line, chr(10) ORDER BY day), chr(10)) AS text FROM w GROUP BY slug"""))
def k5_weekly_maps(spark, d):
    """A map of each ISO week's days with their main topics."""
    counts = t.classified(spark, d).select("day", F.element_at("topics", 1).alias("topic")).groupBy("day", "topic").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "topic"))).where("r <= 10")
    days = ranked.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "topic"))), lambda x: x.topic).alias("topics"))
    return artifacts.rendered(artifacts.weekly_maps(days))
