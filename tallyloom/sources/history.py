"""Sources of personal activity: browser history databases, assistant and tool logs, version control, rank and domain lists."""

from __future__ import annotations

import configparser
import json
import re
import shutil
import sqlite3
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VISITS = "url string, title string, us long, visit_count long"
#: Of each kind of history database: its query, whose times count from the epoch given below.
QUERIES = {
    "chromium": "SELECT u.url, coalesce(u.title, ''), v.visit_time, u.visit_count FROM visits v JOIN urls u ON v.url = u.id WHERE v.visit_time > ? AND (v.transition & 255) NOT IN (3, 4)",
    "firefox": "SELECT p.url, coalesce(p.title, ''), v.visit_date, 1 FROM moz_historyvisits v JOIN moz_places p ON v.place_id = p.id WHERE v.visit_date > ?",
    "safari": "SELECT i.url, coalesce(v.title, ''), v.visit_time, 1 FROM history_visits v JOIN history_items i ON v.history_item = i.id WHERE v.visit_time > ?",
}
CHROMIUM_EPOCH_US, SAFARI_EPOCH_S = 11_644_473_600_000_000, 978_307_200


def native(kind: str, us: int):
    return us + CHROMIUM_EPOCH_US if kind == "chromium" else us if kind == "firefox" else us / 1e6 - SAFARI_EPOCH_S


def micros(kind: str, value) -> int:
    return int(value) - CHROMIUM_EPOCH_US if kind == "chromium" else int(value) if kind == "firefox" else round((value + SAFARI_EPOCH_S) * 1e6)


class Profile(InputPartition):
    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path


class HistoryReader(DataSourceReader):
    """One partition for each database file; the lower time bound is part of the database's own query."""

    def __init__(self, options):
        self.kind, self.since = options.get("kind", "chromium"), int(options.get("since_us", "0"))
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [Profile(self.kind, p) for p in self.paths]

    def read(self, partition):
        """A file that is not there or is no database of its kind has no rows; a damaged file, or an error after the first row, is raised, so that no part of a history passes for the whole."""
        seen = False
        with tempfile.TemporaryDirectory() as held:  # a browser may hold a lock on its own file
            try:
                copy = shutil.copy(partition.path, held)
                with sqlite3.connect(copy) as db:
                    for url, title, at, n in db.execute(QUERIES[partition.kind], (native(partition.kind, self.since),)):
                        seen = True
                        yield url, title, micros(partition.kind, at), n
            except OSError:
                return
            except sqlite3.DatabaseError as broken:
                if seen or "malformed" in str(broken):
                    raise


class HistorySource(DataSource):
    """spark.read.format("browser_history") with options kind, paths (comma-separated) and since_us."""

    @classmethod
    def name(cls):
        return "browser_history"

    def schema(self):
        return VISITS

    def reader(self, schema):
        return HistoryReader(self.options)


def browser_history(spark: SparkSession, kind: str, paths: list[str], since_us: int = 0) -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format("browser_history").options(kind=kind, paths=",".join(paths), since_us=str(since_us)).load()


def log_time(number: Column, text: Column) -> Column:
    """Seconds, milliseconds or an ISO time, as a timestamp."""
    n = number.cast("double")
    return F.coalesce(F.timestamp_millis((F.when(n > 1e10, n).otherwise(n * 1000)).cast("long")), F.try_to_timestamp(text))


NOISE_TAGS = r"^\s*<(local-command|command-name|command-message|system-reminder|task-notification|user-prompt|bash-|environment_context|user_instructions|INSTRUCTIONS)"
NOISE_PREFIXES = ("Caveat:", "[Request interrupted", "This session is being continued", "# AGENTS.md", "Base directory for this skill")


def is_noise(prompt: Column) -> Column:
    """Protocol messages, known boilerplate, texts too short or too long, headings and JSON blobs."""
    t = F.ltrim(prompt)
    prefix = F.lit(False)
    for p in NOISE_PREFIXES:
        prefix = prefix | t.startswith(p)
    return prompt.rlike(NOISE_TAGS) | prefix | (F.length(t) < 20) | (F.length(t) > 1500) | t.rlike("^#{1,3} ") | ((F.length(t) > 300) & t.rlike(r"(?s)^\{.*\}\s*$"))


def assistant_logs(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """prompt, time, project, conversation_file, is_opener, turn_count of the users' messages in *.jsonl files below the folder."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    raw = (reader.option("modifiedAfter", since) if since else reader).text(folder)
    line = F.col("value")
    content = F.coalesce(F.get_json_object(line, "$.message.content"), F.get_json_object(line, "$.content"))
    blocks = F.from_json(content, "array<struct<text:string>>")
    text = F.when(content.startswith("["), F.array_join(F.transform(blocks, lambda b: b.text), " ")).otherwise(content)
    stamp = F.coalesce(F.get_json_object(line, "$.timestamp"), F.get_json_object(line, "$.created_at"))
    number = F.when(stamp.rlike(r"^[0-9]+(\.[0-9]+)?$"), stamp)
    rows = raw.select(F.col("_metadata.file_path").alias("conversation_file"), F.col("_metadata.file_modification_time").alias("modified"), line.alias("value"), text.alias("prompt"), log_time(number, stamp).alias("own"), F.coalesce(F.get_json_object(line, "$.message.role"), F.get_json_object(line, "$.role")).alias("role"), F.get_json_object(line, "$.cwd").alias("cwd"), F.monotonically_increasing_id().alias("seq"))
    per_file = Window.partitionBy("conversation_file")
    rows = rows.withColumn("project", F.substring_index(F.first("cwd", True).over(per_file.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "/", -1)).withColumn("time", F.coalesce("own", "modified"))
    kept = rows.where((F.col("role") == "user") & F.col("prompt").isNotNull() & ~is_noise(F.col("prompt")))
    if since:
        kept = kept.where(F.col("time") >= F.lit(since).cast("timestamp"))
    short = F.when(F.length("prompt") > 200, F.concat(F.substring("prompt", 1, 200), F.lit("…"))).otherwise(F.col("prompt"))
    return kept.select(short.alias("prompt"), "time", "project", "conversation_file", (F.row_number().over(per_file.orderBy("seq")) == 1).alias("is_opener"), F.count("*").over(per_file).alias("turn_count")).where("project is null or project <> 'subagents'")


INJECTED = ("<environment_context", "<user_instructions", "<permissions", "# AGENTS.md", "<INSTRUCTIONS", "<turn_aborted", "<image")


def tool_logs(spark: SparkSession, folder: str) -> DataFrame:
    """prompt, time, project, conversation_file of command-line assistant logs: a row for each part of a user's message."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder)
    form = "timestamp string, type string, payload struct<cwd:string, role:string, content:array<struct<type:string, text:string>>>"
    rows = raw.select(F.col("_metadata.file_path").alias("conversation_file"), F.from_json("value", form).alias("r"))
    projects = rows.where("r.type = 'session_meta'").groupBy("conversation_file").agg(F.substring_index(F.min("r.payload.cwd"), "/", -1).alias("project"))
    said = rows.where("r.type = 'response_item' and r.payload.role = 'user'").select("conversation_file", F.try_to_timestamp(F.regexp_replace("r.timestamp", "Z$", "")).alias("time"), F.explode("r.payload.content.text").alias("prompt"))
    injected = F.lit(False)
    for p in INJECTED:
        injected = injected | F.col("prompt").startswith(p)
    return said.where((F.length("prompt") > 5) & ~injected).join(projects, "conversation_file", "left").select("prompt", "time", "project", "conversation_file")


HEADER = r"^[0-9a-f]{7,40}\|"


def git_output(repo: str, since: str, author: str | None = None, timeout: int = 10) -> str:
    """The log of one repository, in the form that parse_git_log reads."""
    author = author or subprocess.run(["git", "-C", repo, "config", "user.email"], capture_output=True, text=True, timeout=5, check=False).stdout.strip()
    call = ["git", "-C", repo, "log", "--all", "--numstat", f"--since={since}", "--format=%H|%D|%s|%aI", *([f"--author={author}"] if author else [])]
    return subprocess.run(call, capture_output=True, text=True, timeout=timeout, check=False).stdout


def git_lines(spark: SparkSession, repos: list[str], since: str) -> DataFrame:
    """repo, n, line, read by one task for each repository."""

    def work(batches):
        for b in batches:
            for repo in b["repo"]:
                lines = git_output(repo, since).splitlines()
                yield pd.DataFrame({"repo": [Path(repo).name] * len(lines), "n": range(len(lines)), "line": lines})

    return spark.createDataFrame([(r,) for r in repos], "repo string").repartition(max(1, len(repos))).mapInPandas(work, "repo string, n long, line string")


def parse_git_log(lines: DataFrame) -> DataFrame:
    """hash, message, time, repo, files_changed, insertions, deletions from lines (repo, n, line): headers `hash|refs|subject|time`, then numstat rows.

    A repository's log is one ordered stream, so its lines are numbered within the repository."""
    order = Window.partitionBy("repo").orderBy("n")
    blocks = lines.withColumn("commit", F.sum(F.col("line").rlike(HEADER).cast("int")).over(order))
    parts = F.split("line", r"\|")
    heads = blocks.where(F.col("line").rlike(HEADER)).select("repo", "commit", parts[0].alias("hash"), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.lit(0), F.size(parts) - 3)), "|").alias("message"), F.try_to_timestamp(F.element_at(parts, -1)).alias("time"))
    stat = F.split("line", "\t")
    files = blocks.where(F.size(stat) == 3).select("repo", "commit", F.try_to_number(F.regexp_replace(stat[0], "-", ""), F.lit("999999999")).cast("long").alias("i"), F.try_to_number(F.regexp_replace(stat[1], "-", ""), F.lit("999999999")).cast("long").alias("d"))
    sums = files.groupBy("repo", "commit").agg(F.count("*").alias("files_changed"), F.coalesce(F.sum("i"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("d"), F.lit(0)).alias("deletions"))
    stash = F.col("message").rlike(r"^(WIP on |index on |On [^:]+: |untracked files on )")
    first = heads.where(~stash).groupBy("hash").agg(F.min(F.struct("repo", "commit", "message", "time")).alias("x")).select("hash", "x.*")  # a commit of several branches or clones counts once
    joined = first.join(sums, ["repo", "commit"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("hash", "message", "time", "repo", zero("files_changed"), zero("insertions"), zero("deletions"))


def rank_list(spark: SparkSession, path: str, limit: int = 50_000) -> DataFrame:
    """rank, domain (lower case) of a ranking without header."""
    return spark.read.schema("rank long, domain string").csv(path).where(F.col("rank") <= limit).select("rank", F.lower(F.trim("domain")).alias("domain"))


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """domain, category (the folder's name) of domain lists: comments, schemes, paths, ports and www. off; each once."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))), r"^[a-z]+://", "")
    name = F.regexp_replace(F.regexp_replace(name, "[/:].*$", ""), r"^www\.", "")
    return raw.select(name.alias("domain"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("category")).where(F.col("domain").contains(".")).distinct()


def notes(spark: SparkSession, path: str) -> DataFrame:
    """file, front (the YAML block), tags, headings of markdown notes, read back whole."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    return raw.select(F.col("_metadata.file_name").alias("file"), front.alias("front"), F.regexp_extract_all("value", F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1)).alias("tags"), F.regexp_extract_all("value", F.lit(r"(?m)^#{1,6} (.+)$"), F.lit(1)).alias("headings"))


def profile_folders(root: str) -> list[str]:
    """Chromium profile folders below a user-data folder that have a history database."""
    return sorted(str(p.parent) for p in Path(root).glob("*/History") if re.fullmatch(r"Default|Profile \d+|Guest Profile", p.parent.name))


def profiles(kind: str, root: str) -> list[tuple[str, str]]:
    """Name and history database of each profile below a browser's folder: names come from Local State or profiles.ini, if those tell them."""
    folder = Path(root)
    if kind == "chromium":
        try:
            names = json.loads((folder / "Local State").read_text())["profile"]["info_cache"]
        except (OSError, ValueError, KeyError):
            names = {}
        return [(names.get(Path(p).name, {}).get("name") or Path(p).name, f"{p}/History") for p in profile_folders(root)]
    if kind == "firefox":
        ini = configparser.ConfigParser()
        ini.read(folder / "profiles.ini")
        parts = [ini[x] for x in ini.sections() if x.startswith("Profile") and ini[x].get("Path")]
        found = [(x.get("Name", x["Path"]), (folder / x["Path"] if x.get("IsRelative", "1") == "1" else Path(x["Path"])) / "places.sqlite") for x in parts]
    else:
        found = [("Safari", folder / "History.db")]
    return sorted((name, str(p)) for name, p in found if p.exists())


def selected(found: list[tuple[str, str]], wanted: list[str] | None) -> list[str]:
    """Databases of the profiles that a user has chosen by name or folder; all without a choice."""
    return [p for name, p in found if not wanted or name in wanted or Path(p).parent.name in wanted]
