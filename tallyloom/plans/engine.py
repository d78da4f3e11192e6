"""One day's analysis as named stages, each a DataFrame, and the small note made of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import rules, scrub, urls, words
from ..operators import classify, clusters, engagement, joins, patterns, reports, state, temporal


def day_of(us: str) -> Column:
    return F.floor(F.col(us) / 86_400_000_000)


class Engine:
    """Stages over visits (seq, us, url, title), searches (seq, us, query, engine), prompts (seq, us, prompt, conversation, project) and commits (seq, us, repo, message, insertions,
    deletions). If all of them have user_id, every stage keeps the users apart; stages that depend on time keep the days apart, too. Nothing runs before a stage's DataFrame is used."""

    STAGES = ("filtered", "sanitized", "categorized", "classified", "temporal", "pairs", "relations", "focus", "recurrence", "linked", "scored", "clusters", "units", "tasks", "missions", "budget")

    def __init__(self, visits: DataFrame, searches: DataFrame, prompts: DataFrame, commits: DataFrame, rules_dim: DataFrame, sensitive_dim: DataFrame | None = None, history: DataFrame | None = None, day: Column | None = None, config: EngineConfig = EngineConfig()):
        self.visits, self.searches, self.prompts, self.commits, self.rules_dim, self.config = visits, searches, prompts, commits, rules_dim, config
        self.sensitive_dim, self.day = sensitive_dim, F.current_date() if day is None else day
        self.keys = ["user_id"] if all("user_id" in df.columns for df in (visits, searches, prompts, commits)) else []
        self.days = [*self.keys, "day"]
        self.history = state.empty_history(visits.sparkSession) if history is None else history

    def stage(self, name: str) -> DataFrame:
        if name not in self.STAGES:
            raise ValueError(f"no stage {name}; there are {', '.join(self.STAGES)}")
        return getattr(self, name)

    @cached_property
    def filtered(self) -> DataFrame:
        """Visits without sensitive ones, or with those redacted."""
        if self.sensitive_dim is None or not self.config.sensitive_categories:
            return self.visits
        marked = engagement.sensitive(self.visits, self.sensitive_dim.where(F.col("category").isin(*self.config.sensitive_categories)))
        out = engagement.redact(marked) if self.config.sensitivity_action == "redact" else marked.where("sensitive_category is null")
        return out.drop("sensitive_category")

    @cached_property
    def sanitized(self) -> DataFrame:
        return self.filtered.withColumns({"url": scrub.secrets(urls.sanitize(F.col("url"))), "title": scrub.text(F.col("title"))})

    @cached_property
    def categorized(self) -> DataFrame:
        rows = self.sanitized.withColumn("domain", urls.host(F.col("url")))
        return joins.by_domain_rule(rows, self.rules_dim).withColumn("category", F.coalesce("category", F.lit("other")))

    @cached_property
    def classified(self) -> DataFrame:
        searches = self.searches.withColumn("query", scrub.text(F.col("query")))
        prompts = self.prompts.withColumn("prompt", scrub.markup_artifacts(scrub.text(F.col("prompt"))))
        commits = self.commits.withColumn("message", scrub.text(F.col("message")))
        k = self.keys
        raw = classify.raw_visits(self.categorized, k).unionByName(classify.raw_searches(searches, k)).unionByName(classify.raw_prompts(prompts, k)).unionByName(classify.raw_commits(commits, k))
        return classify.by_rules(raw).withColumns({"hour": F.floor(F.col("us") / 3_600_000_000).cast("long") % 24, "day": day_of("us")})

    @cached_property
    def gated(self) -> DataFrame:
        return classify.gated(self.classified) if self.config.gate_uncategorised else self.classified

    @cached_property
    def temporal(self) -> DataFrame:
        e = self.gated.where("us is not null")
        return temporal.described_islands(temporal.hour_islands(e, self.days).where(F.col("event_count") >= self.config.min_cluster_size), e, self.days)

    @cached_property
    def pairs(self) -> DataFrame:
        e = self.gated.where("us is not null")
        w = temporal.anchored_windows(e, self.days, self.config.cooccurrence_minutes)
        w = w.join(e.select(*self.days, "seq", "us", "topics"), [*self.days, "seq"])
        return patterns.cooccurrences(w, self.days, by=self.keys)

    @cached_property
    def relations(self) -> DataFrame:
        return patterns.entity_relations(self.gated, by=self.keys)

    @cached_property
    def focus(self) -> DataFrame:
        return patterns.focus_score(self.classified, self.days)

    @cached_property
    def recurrence(self) -> DataFrame:
        return state.recurrence(self.gated.select(F.explode("topics").alias("topic")), self.history, self.day)

    @cached_property
    def linked(self) -> DataFrame:
        return joins.link_searches(self.searches, self.sanitized, self.config.link_minutes, self.keys)

    @cached_property
    def scored(self) -> DataFrame:
        v = self.categorized
        return engagement.scores(v, engagement.linked_urls(self.searches, v, self.config.link_minutes, self.keys), self.keys)

    @cached_property
    def clusters(self) -> DataFrame:
        """Clusters of substantive visits: cluster, n, label, intent_signal, score."""
        rows = self.scored.where(F.col("engagement") >= self.config.engagement_threshold).withColumns({"terms": words.tokens(words.clean_title(F.col("title"))), "day": day_of("us")})
        members = clusters.greedy(rows, self.days, self.config.cluster_gap_minutes, self.config.cluster_similarity)
        members = members.withColumn("cluster", F.concat_ws("-", *[F.col(c).cast("string") for c in [*self.days, "cluster"]]))
        rows = rows.join(members, [*self.days, "seq"])
        sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("engagement").alias("score")).where("n >= 2")
        return sizes.join(clusters.labels(rows, "title"), "cluster", "left").join(clusters.cluster_intent(rows), "cluster")

    @cached_property
    def units(self) -> DataFrame:
        return temporal.work_units(self.commits, self.keys, self.config.commit_gap_minutes).orderBy(F.desc("start_us"), "repo", "session")

    @cached_property
    def tasks(self) -> DataFrame:
        files = self.prompts.groupBy(*self.keys, "conversation").agg(F.min_by("prompt", F.struct("us", "seq")).alias("opener"), F.count("*").alias("turn_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
        kind = rules.task_type(F.col("opener"))
        return files.select(*self.keys, "conversation", rules.task_title(F.col("opener")).alias("title"), kind.alias("task_type"), rules.interaction_mode(kind).alias("mode"), "turn_count", "start_us", "end_us")

    @cached_property
    def missions(self) -> DataFrame:
        s = self.searches.withColumns({"content": words.content_words(F.col("query")), "day": day_of("us")})
        found = temporal.search_missions(s, self.days, self.config.mission_minutes)
        return s.join(found, [*self.days, "seq"]).groupBy(*self.days, "mission").agg(F.min_by("query", F.struct("us", "seq")).alias("label"), F.count("*").alias("queries"), F.min("us").alias("us"), F.max("us").alias("until"))

    @cached_property
    def budget(self) -> DataFrame:
        return reports.budget_shares(self.classified.groupBy(*self.keys, "source").agg(F.count("*").alias("n")), self.config.prompt_budget, self.keys)

    def for_model(self) -> DataFrame:
        """What the privacy tier lets leave the machine."""
        return reports.tier_view(self.gated, self.config.privacy_tier)

    def resurfaced(self, notes: DataFrame) -> DataFrame:
        """Returning and rising topics that have a note (column topic) and were last seen before today, four at most."""
        r = self.recurrence.where(F.col("trend").isin("returning", "rising") & (F.col("prev_last_seen") < self.day))
        return r.join(notes.select("topic"), "topic", "left_semi").orderBy(F.desc("frequency"), "topic").limit(4)

    def note(self) -> str:
        """A small markdown note of the day's aggregates."""
        parts = (("Focus", self.focus.orderBy(F.desc("n_events")).limit(10)), ("Activity", patterns.activity_distribution(self.classified)), ("Hours", self.temporal.select(*self.days, "label", "event_count").orderBy(F.desc("event_count"), "label").limit(8)), ("Topics", self.recurrence.orderBy(*state.by_trend(self.recurrence)).drop("prev_last_seen").limit(10)), ("Tasks", self.tasks.select("title", "task_type", "turn_count").orderBy("title").limit(10)))
        return "\n\n".join([*[reports.markdown(df, title) for title, df in parts], "## Notes\n"])
