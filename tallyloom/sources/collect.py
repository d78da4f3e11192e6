"""From raw browser rows to visits and searches: exclusion, redirects, search hits and deduplication as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import urls
from ..operators import dedup

#: Hosts of search engines and the parameter that holds the query.
ENGINES = (("google.com", "q"), ("bing.com", "q"), ("duckduckgo.com", "q"), ("search.yahoo.com", "p"), ("ecosia.org", "q"), ("kagi.com", "q"), ("perplexity.ai", "q"), ("yandex.com", "text"))


def search_hit(url: Column) -> Column:
    """engine and query of a results page of the first engine that fits, else null."""
    host, out = urls.host(url), None
    for engine, name in ENGINES:
        query = urls.parameter(url, name)
        hit = host.contains(engine) & query.isNotNull() & ~F.coalesce(query, F.lit("")).startswith("http")
        value = F.struct(F.lit(engine).alias("engine"), F.trim(query).alias("query"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_wanted(url: Column, excluded: tuple[str, ...]) -> Column:
    """Web pages whose host has none of the excluded parts."""
    host, bad = urls.host(url), F.lit(False)
    for part in excluded:
        bad = bad | host.contains(part)
    return urls.scheme(url).isin("http", "https") & ~bad


def collect(raw: DataFrame, config: EngineConfig, since_us: int, until_us: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Visits (deduplicated) and searches (the latest of each query) of raw rows seq, us, url, title. The day is half-open if the configuration bounds it."""
    rows = raw.where((F.col("us") >= since_us) & (F.lit(True) if until_us is None or not config.bounded_day else F.col("us") < until_us))
    rows = dedup.follow_redirects(rows.where(is_wanted(F.col("url"), config.excluded_hosts)).select("seq", "us", "url", "title"))
    marked = rows.withColumn("hit", search_hit(F.col("url")))
    searches = marked.where("hit is not null").select("seq", "us", "hit.query", "hit.engine")
    searches = dedup.first_per_key(searches.where("query <> ''"), [F.col("query")], [F.desc("us"), F.col("seq")])
    visits = dedup.collapse_near_duplicates(marked.where("hit is null").drop("hit")).drop("copies")
    return dedup.dedup_visits(visits, config.max_visits_per_domain), searches
