"""The offline build of domain rules: rank join, quality reasons, coverage anti-join and capped top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins

#: Endings that are mostly abused, and two-letter ones that are not a country's.
SUSPICIOUS = ("tk", "ml", "ga", "cf", "gq", "pw", "top", "click", "stream")
GENERIC_TWO = ("io", "ai", "co", "me", "tv", "fm", "sh", "is")
#: Platforms whose subdomains are their users' pages or parts.
PLATFORMS = (
    "google.com", "yahoo.com", "microsoft.com", "apple.com", "amazon.com", "facebook.com", "twitter.com", "live.com", "msn.com", "yandex.ru", "mail.ru", "baidu.com", "qq.com", "sina.com.cn", "sina.com",
    "wordpress.com", "blogspot.com", "blogspot.de", "blogspot.fr", "blogspot.nl", "tumblr.com", "medium.com", "wifeo.com", "free.fr", "wixsite.com", "weebly.com", "squarespace.com", "over-blog.com", "canalblog.com",
    "skyrock.com", "unblog.fr", "blog4ever.com", "e-monsite.com", "forumactif.com", "tripod.com", "homestead.com", "freeservers.com", "50megs.com", "8m.com", "hypermart.net", "cjb.net", "geocities.com", "angelfire.com", "yolasite.com",
    "moonfruit.com", "jimdo.com", "webcindario.com", "ifrance.com", "narod.ru", "ucoz.com", "ucoz.net", "no-ip.com", "no-ip.info", "sytes.net", "github.io", "netlify.app", "sourceforge.net", "azurewebsites.net", "cloudfront.net",
    "akamaized.net", "akamaihd.net", "googleapis.com", "googleusercontent.com", "googlevideo.com", "amazonvideo.com", "fbcdn.net", "facebook.net", "tiktokcdn.com", "tiktokcdn-us.com", "tiktokv.com", "nflxvideo.net", "nflxext.com", "netflix.net",
    "pinimg.com", "shopifycdn.com", "alicdn.com", "ebaystatic.com", "espncdn.com", "vimeocdn.com", "licdn.com", "warnerbros.com", "sonypictures.com", "go.com", "rakuten.co.jp", "terra.com.br", "uol.com.br", "onet.pl", "indiatimes.com", "globo.com", "aol.com",
    "orange.fr", "orange.pl", "rambler.ru", "deviantart.com", "livejournal.com",
)


def quality_reason(domain: Column, rank: Column, threshold: int = 20_000) -> Column:
    """The first reason against a domain, or null."""
    ending = F.element_at(F.split(domain, r"\."), -1)
    hyphens = F.length(domain) - F.length(F.replace(domain, F.lit("-"), F.lit("")))
    platform = domain.rlike(r"\.(" + "|".join(p.replace(".", r"\.") for p in PLATFORMS) + ")$") & ~domain.isin(*PLATFORMS)
    return (
        F.when(hyphens > 3, "excessive-hyphens").when(domain.rlike(r"(^|\.)[0-9]+\.[0-9]+(\.|$)"), "consecutive-digit-segments").when(ending.isin(*SUSPICIOUS), "suspicious-tld")
        .when((F.length(ending) == 2) & ~ending.isin(*GENERIC_TWO) & (rank > threshold), "low-value-cctld").when(platform, "major-platform-subdomain")
    )


def candidates(domains: DataFrame, ranks: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """domains (domain, category): those with a rank and no reason against them that no known pattern covers, the best `cap` of each category."""
    ranked = joins.with_rank(domains, ranks).where("rank is not null")
    good = ranked.where(quality_reason(F.col("domain"), F.col("rank")).isNull())
    new = joins.not_covered(good, known)
    order = Window.partitionBy("category").orderBy("rank", "domain")
    return new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("category", "domain", "rank", F.col("n").cast("long").alias("n"))


def rejections(domains: DataFrame) -> DataFrame:
    """reason, n of domains with rank."""
    return domains.select(F.coalesce(quality_reason(F.col("domain"), F.col("rank")), F.lit("passed")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
