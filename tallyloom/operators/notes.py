"""Notes as tables: their lines and sections, what a user wrote in them, the merge into a note that is made anew, facts read back, and answers of models cut into sections, lists and reflections.

A note is a row (note_id, text). It is cut into lines once; what a line belongs to follows from running windows over the lines of its note, so notes of all users and days are handled in one pass and only a
single note is ever in one task. Null texts are empty notes; a note without a counterpart stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings of generated sections. Any other section is the user's.
GENERATED = ("Notable", "Cognitive Patterns", "Knowledge Insights", "Searches", "Today I Read About", "Today I Worked On", "Today I Asked Claude About", "Task Sessions", "Claude Code / AI Work", "Browser Activity", "Git Activity", "Learnings", "Remember", "Note Seeds", "Reflection", "Resurface")
#: What stands where a user has written nothing yet, and the section that keeps a note that was there before.
PLACEHOLDER, SOFT_CLOSE, PRESERVED = "> _Add your reflections here_", "_Anything else on your mind today?_", "Previous Content (preserved)"
FIELD = r"^((?:answer|reflect)_[a-z0-9_-]+)::\s*(.*)$"
FOOTER, CLOSING = "\n---\n", "*Generated"
NOTICE = "> What stood here before this note was first generated. It stays through later runs.\n\n"
#: Pictographs, joiners and white space before a heading's name.
DECORATION = r"^[\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}\x{FE0F}\x{200D}\s]+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(notes: DataFrame, keep: list[str]) -> DataFrame:
    """keep, i (from 0), line."""
    return notes.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))


def joined(of: Column) -> Column:
    """The lines gathered (structs of i and line; nulls are left out), in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(of)), lambda x: x.line), "\n")


def section_lines(notes: DataFrame, generated: tuple[str, ...] = GENERATED) -> DataFrame:
    """note_id, i, line, section (0 before the first heading), name, kind (notes, reflection, preserved, generated, custom), opens (it is the section's heading), inside (before the point at
    which the section ends). A preserved section goes on over any headings in it, up to the footer."""
    order = Window.partitionBy("note_id").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    head, name = F.col("line").startswith("## "), F.regexp_replace(trimmed(F.substring("line", 4, 1_000_000)), DECORATION, "")
    after, later = F.lead("line", 1, "").over(order), F.lead("line", 2, "").over(order)
    rule = F.col("line") == "---"
    rows = lines(notes, ["note_id"]).withColumns({"_head": head, "_name": name, "_foot": rule & ((after == "") | after.startswith(CLOSING)), "_end": rule & (after == "") & later.startswith(CLOSING)})
    held = F.col("_head") & (F.col("_name") == PRESERVED)
    rows = rows.withColumn("_state", F.coalesce(F.last(F.when(F.col("_foot"), 0).when(held, 1), ignorenulls=True).over(so_far), F.lit(0)))
    before = F.coalesce(F.lag("_state").over(order), F.lit(0))
    rows = rows.withColumn("opens", F.col("_head") & ((F.col("_state") == 0) | (held & (before == 0))))
    rows = rows.withColumns({"section": F.sum(F.col("opens").cast("int")).over(so_far), "name": F.last(F.when(F.col("opens"), F.col("_name")), ignorenulls=True).over(so_far)})
    kind = F.when(F.col("section") > 0, F.when(F.col("name") == "Notes", "notes").when(F.col("name") == "Reflection", "reflection").when(F.col("name") == PRESERVED, "preserved").when(F.col("name").isin(*generated), "generated").otherwise("custom"))
    rows = rows.withColumn("kind", kind)
    stop = F.when(F.col("kind") == "notes", rule).when(F.col("kind") == "reflection", F.col("_end")).when(F.col("kind") == "preserved", F.col("_state") == 0).otherwise(False)
    within = Window.partitionBy("note_id", "section").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inside", ~F.max(stop).over(within)).select("note_id", "i", "line", "section", "name", "kind", "opens", "inside")


def user_content(notes: DataFrame, generated: tuple[str, ...] = GENERATED) -> DataFrame:
    """note_id, notes (the user's own words, null if none), answers (map of fields), custom (array of whole sections), structured (the note has a generated section)."""
    rows = section_lines(notes, generated).where("kind is not null")
    field = F.col("line").rlike(FIELD) & F.col("inside") & (F.col("kind") == "reflection")
    rows = rows.withColumn("_field", F.max(F.when(field, F.col("i"))).over(Window.partitionBy("note_id", "section")))
    bare = trimmed(F.col("line"))
    free = (F.col("i") > F.col("_field")) & ~((bare == "---") | bare.startswith("> ") | bare.startswith("### ") | (bare == SOFT_CLOSE))
    use = F.col("inside") & F.when(F.col("kind") == "notes", ~F.col("opens")).when(F.col("kind") == "reflection", F.coalesce(free, F.lit(False))).otherwise(F.col("kind") != "generated")
    parts = rows.groupBy("note_id", "section", "kind").agg(joined(F.when(use, F.struct("i", "line"))).alias("body"))
    own = trimmed(F.col("body"))
    written = F.when(F.col("kind").isin("notes", "reflection") & (own != "") & ~((F.col("kind") == "notes") & (own == PLACEHOLDER)), own)
    whole = F.when(F.col("kind").isin("custom", "preserved") & (own != ""), F.struct("section", F.regexp_replace("body", r"\s+$", "").alias("text")))
    shape = rows.groupBy("note_id").agg(F.bool_or(F.col("opens") & F.col("name").isin(*generated)).alias("structured"))
    content = parts.groupBy("note_id").agg(F.max_by(written, F.when(written.isNotNull(), F.col("section"))).alias("notes"), F.transform(F.sort_array(F.collect_list(whole)), lambda x: x.text).alias("custom"))
    value = trimmed(F.regexp_extract("line", FIELD, 2))
    filled = rows.where(field).select("note_id", "section", "i", F.regexp_extract("line", FIELD, 1).alias("field"), value.alias("value")).where("value <> ''")
    answers = filled.groupBy("note_id", "field").agg(F.max_by("value", "i").alias("value")).groupBy("note_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("answers"))
    return shape.join(content, "note_id").join(answers, "note_id", "left").select("note_id", "notes", F.coalesce("answers", F.create_map().cast("map<string,string>")).alias("answers"), "custom", "structured")


def before_footer(text: Column, insert: Column, at_end: Column) -> Column:
    """The text with something in front of its last footer, or, without one, behind it."""
    tail = F.substring_index(text, FOOTER, -1)
    return F.when(text.contains(FOOTER), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail) - len(FOOTER)), insert, F.lit(FOOTER), tail)).otherwise(F.concat(text, at_end))


def replaced_once(text: Column, old: str, new: Column) -> Column:
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + len(old), F.length(text)))


def merged(generated: DataFrame, existing: DataFrame, headings: tuple[str, ...] = GENERATED) -> DataFrame:
    """note_id, text: generated notes with what users wrote in the existing ones. Notes go where their placeholder is, else they become a section; answered fields keep their answers; the user's
    sections stand in front of the footer, in their order. An existing note without any generated section is kept whole in a section of its own. Notes that are no longer generated stay as they are."""
    old = existing.select("note_id", F.col("text").alias("_old"))
    rows = generated.select("note_id", F.coalesce("text", F.lit("")).alias("_new")).join(old, "note_id", "full").join(user_content(existing, headings), "note_id", "left")
    new = F.col("_new")
    note, has = F.col("notes"), F.col("notes").isNotNull()
    placed = F.when(has & new.contains(PLACEHOLDER), replaced_once(new, PLACEHOLDER, note)).when(has & new.contains(SOFT_CLOSE), replaced_once(new, SOFT_CLOSE, F.concat(note, F.lit("\n\n" + SOFT_CLOSE)))).otherwise(new)
    nowhere = has & ~new.contains(PLACEHOLDER) & ~new.contains(SOFT_CLOSE)
    rows = rows.withColumns({"_placed": placed, "_sections": F.when(nowhere, F.concat(F.array(F.concat(F.lit("## Notes\n\n"), note)), F.col("custom"))).otherwise(F.col("custom"))})
    answer = lambda x: F.try_element_at(F.col("answers"), F.regexp_extract(x, FIELD, 1))
    kept = F.transform(F.split("_placed", "\n"), lambda x: F.coalesce(F.concat(F.regexp_extract(x, FIELD, 1), F.lit(":: "), answer(x)), x))
    rows = rows.withColumn("_answered", F.when(F.size("answers") > 0, F.array_join(kept, "\n")).otherwise(F.col("_placed")))
    sections = F.concat(F.lit("\n\n"), F.array_join("_sections", "\n\n"), F.lit("\n"))
    whole = F.when(F.size("_sections") > 0, before_footer(F.col("_answered"), sections, sections)).otherwise(F.col("_answered"))
    kept_whole = F.concat(F.lit(f"{FOOTER}\n## {PRESERVED}\n\n{NOTICE}"), F.col("_old"), F.lit("\n"))
    text = (
        F.when(new.isNull(), F.col("_old")).when(F.col("_old").isNull() | (trimmed(F.col("_old")) == ""), new)
        .when(~F.coalesce("structured", F.lit(False)), before_footer(new, kept_whole, kept_whole)).otherwise(whole)
    )
    return rows.select("note_id", text.alias("text"))


def backups(existing: DataFrame, stamp: str, headings: tuple[str, ...] = GENERATED) -> DataFrame:
    """name, text of the notes that a user has edited and that a merge must not touch without a copy: named after the note and the time stamp."""
    rows = existing.where(trimmed(F.coalesce("text", F.lit(""))) != "").join(user_content(existing, headings), "note_id", "left")
    edited = ~F.coalesce("structured", F.lit(False)) | F.col("notes").isNotNull() | (F.size("answers") > 0) | (F.size("custom") > 0)
    return rows.where(edited).select(F.concat(F.regexp_replace(F.col("note_id").cast("string"), r"\.md$", ""), F.lit(f".{stamp}.bak.md")).alias("name"), "text")


#: Elements of a details block that are no sections of a prompt.
PLAIN_TAGS = ("summary", "details", "br", "p", "pre", "code")
STATS = r"\[!info\]\s+(\d+)\s+visits\s+·\s+(\d+)\s+searches\s+·\s+(\d+)\s+AI prompts\s+·\s+(\d+)\s+commits\s+·\s+(\d+)\s+categories"
SENT = r"<summary>\s*Prompt sent to ([^\s·]+)\s+·\s+(\d+)\s+tokens\s+·\s+Tier\s+(\d+)"


def facts(notes: DataFrame) -> DataFrame:
    """What a finished note says of itself: front (map of its front matter, the last of equal keys), visits, searches, prompts, commits, categories (0 without a line of counts), model, tokens, tier (null
    without a prompt block), prompt_sections and headings."""
    text = F.coalesce("text", F.lit(""))
    pairs = F.filter(F.split(F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1), "\n"), lambda x: x.contains(":"))
    entry = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(entry, lambda x, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda y: y.k == x.k))
    count = lambda k: F.coalesce(F.expr("try_cast(nullif(_c%d, '') as long)" % k), F.lit(0))
    rows = notes.withColumns({f"_c{k}": F.regexp_extract(text, STATS, k) for k in range(1, 6)} | {f"_s{k}": F.regexp_extract(text, SENT, k) for k in range(1, 4)})
    body = F.regexp_extract(text, r"<details>([\s\S]*?)</details>", 1)
    tags = F.when(F.col("_s1") != "", F.filter(F.regexp_extract_all(body, F.lit("<([a-z_]+)>"), F.lit(1)), lambda x: ~x.isin(*PLAIN_TAGS))).otherwise(F.array().cast("array<string>"))
    heads = F.transform(F.filter(F.split(text, "\n"), lambda x: x.startswith("## ")), lambda x: trimmed(F.substring(x, 4, 1_000_000)))
    number = lambda k: F.expr(f"try_cast(nullif(_s{k}, '') as long)")
    names = ("visits", "searches", "prompts", "commits", "categories")
    return rows.select("note_id", F.map_from_entries(last).alias("front"), *[count(k + 1).alias(n) for k, n in enumerate(names)], F.expr("nullif(_s1, '')").alias("model"), number(2).alias("tokens"), number(3).alias("tier"), tags.alias("prompt_sections"), heads.alias("headings"))


def answer_sections(answers: DataFrame) -> DataFrame:
    """note_id, heading (lower case), content of answers cut at their headings; of equal headings the last with content counts, text before the first is dropped."""
    order = Window.partitionBy("note_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("line", r"^##\s+(.+)$", 1)
    rows = lines(answers, ["note_id"]).withColumn("_head", F.when(head != "", F.lower(trimmed(head))))
    rows = rows.withColumns({"section": F.count("_head").over(order), "heading": F.last("_head", ignorenulls=True).over(order)}).where("section > 0")
    parts = rows.groupBy("note_id", "section", "heading").agg(trimmed(joined(F.when(F.col("_head").isNull(), F.struct("i", "line")))).alias("content")).where("content <> ''")
    return parts.groupBy("note_id", "heading").agg(F.max_by("content", "section").alias("content"))


def bullet_items(sections: DataFrame) -> DataFrame:
    """note_id, heading, n (from 1), item: a list's items; a line without a bullet goes on with the item before it, or is the first."""
    keys = ["note_id", "heading"]
    rows = lines(sections.withColumnRenamed("content", "text"), keys).withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    order = Window.partitionBy(*keys).orderBy("i")
    bullet = F.col("line").rlike(r"^[-*•]\s+")
    first = F.row_number().over(order) == 1
    rows = rows.withColumn("_start", (bullet | first).cast("int")).withColumn("line", F.when(bullet, trimmed(F.regexp_replace("line", r"^[-*•]\s+", ""))).otherwise(F.col("line")))
    rows = rows.withColumn("n", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x.line), " ").alias("item"))


TAGGED = r"^\s*[-*•]\s*\*\*([a-z0-9][-a-z0-9]*)\*\*:\s*(.+)$"


def reflections(sections: DataFrame) -> DataFrame:
    """note_id, n (from 1), id, question: tagged lines of the section of that name; of equal tags the next become tag_2, tag_3."""
    rows = lines(sections.where("heading = 'reflections'").withColumnRenamed("content", "text"), ["note_id"])
    rows = rows.select("note_id", "i", F.regexp_extract("line", TAGGED, 1).alias("tag"), trimmed(F.regexp_extract("line", TAGGED, 2)).alias("question")).where("tag <> ''")
    n = F.row_number().over(Window.partitionBy("note_id", "tag").orderBy("i"))
    return rows.select("note_id", F.row_number().over(Window.partitionBy("note_id").orderBy("i")).alias("n"), F.when(n == 1, F.col("tag")).otherwise(F.concat_ws("_", "tag", n.cast("string"))).alias("id"), "question")
