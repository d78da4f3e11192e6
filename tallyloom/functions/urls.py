"""URL columns: hosts, canonical keys, redirects, redaction and display forms. Expressions only; nothing throws on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^?#]*)"
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "si", "igshid")


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def is_valid(url: Column) -> Column:
    return part(url, 2) != ""


def host(url: Column) -> Column:
    """Lower-case, without www.; empty if the URL has none."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def path(url: Column) -> Column:
    p = part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def canonical_key(url: Column) -> Column:
    """https, bare host and path; without query, fragment, port and closing slashes. On maps hosts the viewport goes too."""
    h, p = host(url), path(url)
    maps = h.isin("maps.google.com", "google.com") & p.startswith("/maps/")
    plain = F.regexp_replace(p, "/+$", "")
    kept = F.when(maps, F.substring_index(p, "/@", 1)).when(plain == "", "/").otherwise(plain)
    return F.when(is_valid(url), F.concat(F.lit("https://"), h, kept)).otherwise(url)


def parameter(url: Column, name: str) -> Column:
    """The decoded value of a query parameter, or null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{name}=([^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def unwrap_redirect(url: Column) -> Column:
    """Where a google.com/url link leads, if to https; else null."""
    target = F.coalesce(parameter(url, "q"), parameter(url, "url"))
    return F.when((host(url) == "google.com") & (part(url, 4) == "/url") & target.startswith("https://"), target)


def sanitize(url: Column) -> Column:
    """Scheme, host with port and path; other schemes and malformed URLs are redacted."""
    other = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = F.concat(scheme(url), F.lit("://"), F.lower(part(url, 2)), part(url, 3), path(url))
    return F.when(is_valid(url) & scheme(url).startswith("http"), web).when(other != "", F.concat(other, F.lit(":[REDACTED]"))).otherwise("[INVALID_URL]")


#: Hosts of links that hide where they lead, and what they are called.
WRAPPERS = (
    (r"\.hubspotlinks\.com$", "HubSpot tracking link"), (r"\.hs-email\.net$", "HubSpot tracking link"), (r"\.sidekickopen[0-9]*\.com$", "HubSpot tracking link"), (r"\.na[0-9]+\.hs-sales-engage\.com$", "HubSpot tracking link"),
    (r"safelinks\.protection\.outlook\.com$", "Outlook SafeLink"), (r"urldefense\.proofpoint\.com$", "Proofpoint link"), (r"urldefense\.com$", "Proofpoint link"), (r"url[0-9]*\.mimecastprotect\.com$", "Mimecast link"),
    (r"\.sendgrid\.net$", "SendGrid tracking link"), (r"click\.mailchimp\.com$", "Mailchimp tracking link"), (r"mandrillapp\.com$", "Mandrill tracking link"), (r"click\.marketo\.com$", "Marketo tracking link"),
    (r"tracking\.constantcontact\.com$", "Constant Contact link"), (r"click\.convertkit-mail\.com$", "ConvertKit link"),
    (r"^t\.co$", "Twitter/X short link"), (r"^bit\.ly$", "bit.ly short link"), (r"^ow\.ly$", "Hootsuite short link"), (r"^buff\.ly$", "Buffer short link"), (r"^tinyurl\.com$", "TinyURL link"),
)


def display(url: Column, limit: int = 120, least: int = 30) -> Column:
    """A hiding link's host and kind; else the URL without tracking parameters and fragment, cut at the last ?, & or / beyond `least` characters if it is longer than the limit."""
    name = F.lower(part(url, 2))
    kind = F.coalesce(*[F.when(name.rlike(p), F.lit(label)) for p, label in WRAPPERS])
    base = F.regexp_extract(F.coalesce(url, F.lit("")), "^([^?#]*)", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*TRACKING))
    whole = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    back = F.reverse(F.substring(whole, 1, limit + 1))
    at = lambda mark: F.when(F.locate(mark, back) > 0, F.length(back) - F.locate(mark, back))
    cut = F.coalesce(*[F.when(at(m) > least, at(m)) for m in "?&/"], F.lit(limit))
    return F.when(is_valid(url) & kind.isNotNull(), F.concat(name, F.lit(" ["), kind, F.lit("]"))).when(F.length(whole) > limit, F.concat(F.substring(whole, F.lit(1), cut), F.lit("…"))).otherwise(whole)


def suffixes(name: Column) -> Column:
    """a.b.c gives [a.b.c, b.c, c]: what an exact or parent-domain rule can match."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
