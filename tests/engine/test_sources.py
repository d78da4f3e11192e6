"""Sources over files made here, and the streaming jobs."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import history
from tallyloom.streaming import jobs


def test_browser_databases(spark, tmp_path):
    c = tmp_path / "History"
    with sqlite3.connect(c) as db:
        db.execute("CREATE TABLE urls (id, url, title, visit_count)")
        db.execute("CREATE TABLE visits (url, visit_time, transition)")
        db.execute("INSERT INTO urls VALUES (1, 'https://a.com', 'A', 3)")
        db.executemany("INSERT INTO visits VALUES (1, ?, ?)", [(13412952000000000, 0), (13412952000000001, 3), (5, 1)])
    f = tmp_path / "places.sqlite"
    with sqlite3.connect(f) as db:
        db.execute("CREATE TABLE moz_places (id, url, title)")
        db.execute("CREATE TABLE moz_historyvisits (place_id, visit_date)")
        db.execute("INSERT INTO moz_places VALUES (1, 'https://b.com', NULL)")
        db.execute("INSERT INTO moz_historyvisits VALUES (1, 1700000000000000)")
    s = tmp_path / "History.db"
    with sqlite3.connect(s) as db:
        db.execute("CREATE TABLE history_items (id, url)")
        db.execute("CREATE TABLE history_visits (history_item, visit_time, title)")
        db.execute("INSERT INTO history_items VALUES (1, 'https://c.com')")
        db.execute("INSERT INTO history_visits VALUES (1, 0.5, 'C')")
    got = history.browser_history(spark, "chromium", [str(c), str(tmp_path / "missing")], 0).collect()
    assert [(r["url"], r["title"], r["us"], r["visit_count"]) for r in got] == [("https://a.com", "A", 1768478400000000, 3)]
    assert [tuple(r) for r in history.browser_history(spark, "firefox", [str(f)]).collect()] == [("https://b.com", "", 1700000000000000, 1)]
    assert [r["us"] for r in history.browser_history(spark, "safari", [str(s)]).collect()] == [978307200500000]
    assert history.browser_history(spark, "firefox", [str(f)], 1700000000000000).count() == 0


def test_assistant_logs(spark, tmp_path):
    folder = tmp_path / "p" / "q"
    folder.mkdir(parents=True)
    lines = [
        {"cwd": "/home/x/proj", "role": "user", "content": "please add a parser for the log", "timestamp": 1700000000},
        {"message": {"role": "user", "content": [{"text": "now fix the failing"}, {"text": "unit tests"}]}, "timestamp": "2023-11-14T22:20:00Z"},
        {"role": "assistant", "content": "done, all of it is there now"}, {"role": "user", "content": "short"}, {"role": "user", "content": "<system-reminder>long enough text</system-reminder>"},
    ]
    (folder / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    got = history.assistant_logs(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r["prompt"], r["project"], r["is_opener"], r["turn_count"]) for r in got] == [("please add a parser for the log", "proj", True, 2), ("now fix the failing unit tests", "proj", False, 2)]


def test_tool_logs(spark, tmp_path):
    lines = [
        {"timestamp": "2025-01-01T10:00:00Z", "type": "session_meta", "payload": {"cwd": "/x/tool"}},
        {"timestamp": "2025-01-01T10:01:00Z", "type": "response_item", "payload": {"role": "user", "content": [{"type": "t", "text": "<environment_context>"}, {"type": "t", "text": "run the tests"}, {"type": "t", "text": "hi"}]}},
    ]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [(r["prompt"], r["project"]) for r in history.tool_logs(spark, str(tmp_path)).collect()] == [("run the tests", "tool")]


def test_git_log(spark):
    log = ["a" * 40 + "||feat: a|b|2025-01-01T10:00:00+00:00", "", "40\t5\tx.py", "10\t5\ty.py", "-\t-\tz.png", "b" * 40 + "||WIP on main: x|2025-01-01T11:00:00+00:00", "c" * 40 + "||fix: c|2025-01-01T12:00:00+00:00", "", "12\t3\tq"]
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(log)], "repo string, n long, line string")
    got = sorted((r["message"], r["files_changed"], r["insertions"], r["deletions"]) for r in history.parse_git_log(lines).collect())
    assert got == [("feat: a|b", 3, 50, 10), ("fix: c", 1, 12, 3)]


def test_lists_and_notes(spark, tmp_path):
    (tmp_path / "rank.csv").write_text("1,A.com\n2,b.com\n60000,c.com\n")
    assert [tuple(r) for r in history.rank_list(spark, str(tmp_path / "rank.csv")).collect()] == [(1, "a.com"), (2, "b.com")]
    (tmp_path / "lists" / "games").mkdir(parents=True)
    (tmp_path / "lists" / "games" / "domains").write_text("# c\nhttps://www.X.com/a\nx.com\nlocal\ny.org:80\n")
    assert sorted(tuple(r) for r in history.domain_list(spark, str(tmp_path / "lists")).collect()) == [("x.com", "games"), ("y.org", "games")]
    (tmp_path / "n.md").write_text("---\nid: 1\n---\n# Day\n#tag text\n## Notes\n")
    r = history.notes(spark, str(tmp_path)).first()
    assert (r["front"], r["tags"], r["headings"]) == ("id: 1", ["tag"], ["Day", "Notes"])


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("update" if name == "topics" else "append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.com/x?1", "2025-01-01 10:00:05", "u"), ("https://www.a.com/x", "2025-01-01 10:00:40", "u"), ("https://a.com/x", "2025-01-01 10:02:00", "u"), ("https://a.com/z", "2025-01-01 13:00:00", "u"), ("https://a.com/end", "2025-01-02 13:00:00", "w")], "url string, time string, user string").withColumn("time", F.to_timestamp("time"))
    rows.coalesce(1).write.parquet(str(tmp_path / "v"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "v"))
    assert len(run(jobs.suppress_near_duplicates(stream()), "near")) == 4
    assert sorted(r["n"] for r in run(jobs.sessions(stream(), "user"), "gaps")) == [1, 3]
    days = spark.createDataFrame([("a", "2025-01-01"), ("a", "2025-01-01"), ("a", "2025-01-03"), ("b", "2025-01-02")], "topic string, day string").withColumn("day", F.to_date("day"))
    days.coalesce(1).write.parquet(str(tmp_path / "t"))
    got = run(jobs.topic_days(spark.readStream.schema(days.schema).parquet(str(tmp_path / "t"))), "topics")
    assert sorted((r["topic"], r["day_count"], r["last_seen"]) for r in got) == [("a", 2, "2025-01-03"), ("b", 1, "2025-01-02")]


def test_profiles_and_selection(tmp_path):
    chrome, fox = tmp_path / "chrome", tmp_path / "fox"
    for p in ("Default", "Profile 2", "System Profile"):
        (chrome / p).mkdir(parents=True)
        (chrome / p / "History").write_bytes(b"")
    (chrome / "Local State").write_text('{"profile": {"info_cache": {"Profile 2": {"name": "Work"}}}}')
    found = history.profiles("chromium", str(chrome))
    assert [n for n, _ in found] == ["Default", "Work"] and history.selected(found, ["Work"]) == [str(chrome / "Profile 2" / "History")] and len(history.selected(found, None)) == 2
    (fox / "abc.main").mkdir(parents=True)
    (fox / "abc.main" / "places.sqlite").write_bytes(b"")
    (fox / "profiles.ini").write_text("[General]\nX=1\n[Profile0]\nName=main\nIsRelative=1\nPath=abc.main\n[Profile1]\nName=gone\nPath=none\n")
    assert history.profiles("firefox", str(fox)) == [("main", str(fox / "abc.main" / "places.sqlite"))]
    assert history.profiles("safari", str(tmp_path)) == []


def test_no_part_of_a_history_passes_for_the_whole(tmp_path):
    path = tmp_path / "History"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE urls (id INTEGER, url TEXT, title TEXT, visit_count INTEGER)")
        db.execute("CREATE TABLE visits (url INTEGER, visit_time INTEGER, transition INTEGER)")
        db.executemany("INSERT INTO urls VALUES (?, ?, 't', 1)", [(i, "https://a.com/" + "x" * 900) for i in range(400)])
        db.executemany("INSERT INTO visits VALUES (?, ?, 0)", [(i, 13_000_000_000_000_000 + i) for i in range(400)])
    reader = history.HistoryReader({"kind": "chromium", "path": str(path)})
    assert len(list(reader.read(reader.partitions()[0]))) == 400
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2 : len(raw) // 2 + 40_000] = b"\xff" * 40_000
    path.write_bytes(raw)
    with pytest.raises(sqlite3.DatabaseError):
        list(reader.read(reader.partitions()[0]))
    path.write_bytes(b"no database")
    assert list(reader.read(reader.partitions()[0])) == []


def test_row_numbers_over_all_ranges(spark):
    from tallyloom.operators import ordered

    df = spark.createDataFrame([(f"d{i:03}", i % 7) for i in range(200)], "name string, n long")
    got = {r["name"]: r["k"] for r in ordered.row_numbers(df, [F.desc("n"), "name"], "k").collect()}
    assert got == {name: k for k, (_, name) in enumerate(sorted((-(i % 7), f"d{i:03}") for i in range(200)), 1)}
