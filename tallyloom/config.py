"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    max_visits_per_domain: int = 5
    commit_gap_minutes: int = 90
    cooccurrence_minutes: int = 30
    min_cluster_size: int = 3
    link_minutes: int = 5
    mission_minutes: int = 10
    cluster_gap_minutes: int = 45
    cluster_similarity: float = 0.3
    engagement_threshold: float = 0.5
    prompt_budget: int = 3000
    privacy_tier: int = 4
    sensitivity_action: str = "exclude"
    sensitive_categories: tuple[str, ...] = ()
    #: Search, prompt and commit events have no category and so bear no entities; False gives them their own.
    gate_uncategorised: bool = True
    #: Days are half-open; False lets a past day run on to now.
    bounded_day: bool = True
    excluded_hosts: tuple[str, ...] = field(default=("newtab", "extensions", "localhost"))
