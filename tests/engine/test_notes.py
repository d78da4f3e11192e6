from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tallyloom.operators import artifacts, notes, temporal
from tallyloom.sources import sinks
from tallyloom.streaming import jobs

NEW = "# D\n\n## Searches\n\n- new\n\n## Notes\n\n> _Add your reflections here_\n\n## Reflection\n\n> Q?\n---\nreflect_a:: \nreflect_b:: x\n\n---\n_Anything else on your mind today?_\n\n---\n\n*Generated*\n"


def merge(spark, generated, existing):
    frames = [spark.createDataFrame([(k, v) for k, v in x.items()], "note_id string, text string") for x in (generated, existing)]
    return {r["note_id"]: r["text"] for r in notes.merged(*frames).collect()}


def test_what_a_user_wrote_stays(spark):
    old = "# D\n\n## \U0001f50d Searches\n\n- old\n\n## Notes\n\nmine\n- two\n\n---\nnot mine\n\n## Own \n\nkept\n\n## Reflection\n\n> Q?\n---\nreflect_a:: first\nreflect_a::  last \nreflect_c:: gone\n\n---\n\n*Generated*\n"
    answered = NEW.replace("reflect_a:: ", "reflect_a:: last")
    want = answered.replace(notes.PLACEHOLDER, "mine\n- two").replace("\n---\n\n*Generated*", "\n\n## Own \n\nkept\n\n---\n\n*Generated*")
    plain = {"a": old, "b": None, "c": " \n", "e": "## Own\n\nby hand\n", "gone": "text of before", "same": NEW}
    got = merge(spark, {"a": NEW, "b": NEW, "c": NEW, "d": NEW, "e": NEW, "same": NEW, "null": None}, plain)
    assert got["a"] == want and got["b"] == got["c"] == got["d"] == NEW and got["gone"] == "text of before" and got["null"] == ""
    assert got["same"] == NEW.replace("reflect_b:: x", "reflect_b:: x")
    assert got["e"] == NEW.replace("\n---\n\n*Generated*", f"\n---\n\n## {notes.PRESERVED}\n\n{notes.NOTICE}## Own\n\nby hand\n\n\n---\n\n*Generated*")
    again = merge(spark, {"a": NEW, "e": NEW}, {"a": got["a"], "e": got["e"]})
    assert "mine\n- two" in again["a"] and again["a"].count("## Own") == 1 and again["e"].count("## Own") == 1 and again["e"].count("by hand") == 1  # later runs lose and double nothing


def test_notes_without_a_place_become_a_section_and_free_text_of_reflections_counts(spark):
    old = "## Reflection\n\nreflect_a:: y\n---\n> Q\nfree words\n\nmore\n_Anything else on your mind today?_\n"
    short = "## Searches\n- n\n"
    got = merge(spark, {"a": short, "b": "## Reflection\nreflect_a:: \n_Anything else on your mind today?_\n"}, {"a": old, "b": old})
    assert got["a"] == short + "\n\n## Notes\n\nfree words\n\nmore\n"
    assert got["b"] == "## Reflection\nreflect_a:: y\nfree words\n\nmore\n\n_Anything else on your mind today?_\n"
    rows = [("x.md", NEW), ("y.md", old), ("z.md", "by hand"), ("w.md", ""), ("v.md", None)]
    kept = notes.backups(spark.createDataFrame(rows, "note_id string, text string"), "T").collect()
    # x has an answer of its own (reflect_b)
    assert {r["name"] for r in kept} == {"x.T.bak.md", "y.T.bak.md", "z.T.bak.md"}


def test_facts_and_answers(spark):
    df = spark.createDataFrame([(1, None), (2, "no front\n## A\n##B\n## B "), (3, "---\na: 1\nb\na: x: y\n---\n> [!info] 1 visits · 2 searches · 3 AI prompts · 4 commits · 5 categories\n<summary> Prompt sent to m-1 · 77 tokens · Tier 3</summary><details><p><one_two></details>")], "note_id int, text string")
    got = {r["note_id"]: r for r in notes.facts(df).collect()}
    assert got[1]["front"] == {} and got[1]["headings"] == [] and got[1]["visits"] == 0 and got[1]["model"] is None
    assert got[2]["headings"] == ["A", "B"]
    assert got[3]["front"] == {"a": "x: y"} and [got[3][k] for k in ("visits", "searches", "prompts", "commits", "categories", "model", "tokens", "tier")] == [1, 2, 3, 4, 5, "m-1", 77, 3] and got[3]["prompt_sections"] == ["one_two"]
    prose = spark.createDataFrame([(1, "pre\n## Learnings\n\nloose\ngoes on\n- a\n  b\n* c\n## learnings\n\n## Reflections\n- **t-1**: q1 \n- **t-1**: q2\n- **T**: no\n• **u**: q3"), (2, None)], "note_id int, text string")
    sections = notes.answer_sections(prose)
    assert [(r["n"], r["item"]) for r in notes.bullet_items(sections.where("heading = 'learnings'")).orderBy("n").collect()] == [(1, "loose goes on"), (2, "a b"), (3, "c")]
    assert [(r["id"], r["question"]) for r in notes.reflections(sections).orderBy("n").collect()] == [("t-1", "q1"), ("t-1_2", "q2"), ("u", "q3")]


def test_artifacts_unite_links_and_batches_may_come_again(spark, tmp_path):
    day = lambda n: datetime.date(2024, 12, 28) + datetime.timedelta(n)
    mentions = [("Topic A", day(0)), ("topic a", day(0)), ("topic a", day(3)), ("B", day(1)), (None, day(1)), ("C", None)]
    df = spark.createDataFrame(mentions, "name string, day date")
    found = lambda x: artifacts.of_mentions(x, F.lower("name"), "topic").unionByName(artifacts.of_mentions(x, F.lower("name"), "seed"))
    show = lambda x: sorted((r["kind"], r["slug"], r["title"], r["created"], [e["day"] for e in r["links"]]) for r in x.collect())
    path = str(tmp_path / "vault")
    sinks.merge_artifacts(found(df.where("day = '2024-12-28'")), path, 0)
    for _ in range(2):
        sinks.merge_artifacts(found(df.where("day > '2024-12-28'")), path, 1)
    got = show(sinks.read_artifacts(spark, path))
    assert got == [("seed", "b", "B", day(1), [day(1)]), ("seed", "topic a", "Topic A", day(0), [day(0)]), ("topic", "b", "B", day(1), [day(1)]), ("topic", "topic a", "Topic A", day(0), [day(0), day(3)])]
    assert show(artifacts.merged(found(df), found(df))) == got and show(sinks.read_artifacts(spark, str(tmp_path / "none"))) == []
    weeks = artifacts.weekly_maps(spark.createDataFrame([(day(n), ["t"] * n) for n in range(5)], "day date, topics array<string>")).collect()
    assert {(r["slug"], len(r["links"])) for r in weeks} == {("2024-W52", 2), ("2025-W01", 3)} and all(r["links"][0]["extra"] is None for r in weeks if r["slug"] == "2024-W52")


def test_streams_fold_in_time_order_like_batches(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows, us = [], {}
    for seq in range(160):
        at = rng.randrange(60 * 24) * 60 + rng.randrange(3) * 20
        us[seq] = at * 1_000_000
        rows.append((rng.choice("ab"), start + datetime.timedelta(seconds=at), seq, rng.sample(["x", "y", "z", "w", "v"], rng.randrange(3))))
    schema = "key string, time timestamp, seq long, content array<string>"
    folder = str(tmp_path / "in")
    for n in range(4):  # shuffled over the files; a day's allowance keeps them all
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("end", start + datetime.timedelta(days=9), 1000, [])], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("a", start, 2000, ["late"])], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    base = int(start.replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000
    batch = spark.createDataFrame([(k, base + us[s], s, c) for k, _, s, c in rows], "key string, us long, seq long, content array<string>")

    def result(df, name):
        run = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        return sorted(tuple(r) for r in spark.table(name).where("seq < 1000").collect())

    want = sorted(tuple(r) for r in temporal.anchored_windows(batch, ["key"], 30).select("key", "seq", "window", "anchor_us").collect())
    assert result(jobs.anchored_windows(stream, "key", 30, "1 day"), "windows") == want
    want = sorted(tuple(r) for r in temporal.search_missions(batch, ["key"], 30).select("key", "seq", "mission").collect())
    assert result(jobs.search_missions(stream, "key", 30, "1 day"), "missions") == want
