"""Word lists, slugs, titles and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a query, a title or a topic.
QUERY_STOPWORDS = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "was", "will", "had", "has", "is", "it", "its", "of", "to", "in", "on", "at", "an", "a", "be", "do")
LEADING_NOISE = ("the", "a", "an", "this", "that", "these", "those", "my", "our", "your", "his", "her", "its", "their", "some", "any", "all", "each", "every")
TOPIC_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "may", "might", "shall", "must",
    "this", "that", "these", "those", "it", "its", "i", "we", "you", "he", "she", "they", "me", "us", "him", "her", "them", "my", "our", "your", "his", "their",
    "what", "which", "who", "whom", "where", "when", "how", "why", "not", "no", "so", "if", "then", "than", "just", "also", "very",
    "about", "up", "out", "into", "over", "after", "before", "some", "any", "all", "each", "every", "few", "more", "most",
    "other", "last", "first", "next", "new", "old", "same", "thing", "things", "stuff", "way", "lot",
)
#: Endings that sites put behind their titles, first match first, and titles without content.
BRANDS = (" | GitHub", " · GitHub", " - GitHub", " - Stack Overflow", " — Stack Overflow", " | MDN Web Docs", " | TypeScript", " | Google", " - Google Search", " | YouTube", " - YouTube", " | Reddit", " | Obsidian", " | Wikipedia", " - Wikipedia")
NOISE_TITLES = ("Home", "Login", "Sign In", "Dashboard", "Settings", "Profile", "New Tab", "Untitled", "Loading...", "404", "Error", "Page Not Found", "Search Results", "Google", "Bing", "DuckDuckGo")
SEPARATORS = r"\s+[|—–·»]\s+|\s+-\s+"


def clean_title(title: Column) -> Column:
    """Without the site's brand, the longest part between separators (the first among equals); empty if it has no content."""
    brand = F.coalesce(*[F.when(title.endswith(b), F.lit(len(b))) for b in BRANDS])  # no brand ends in another
    bare = F.when(brand.isNotNull(), F.trim(F.substring(title, F.lit(1), F.length(title) - brand))).otherwise(F.coalesce(title, F.lit("")))
    parts = F.transform(F.split(bare, SEPARATORS), lambda x: F.trim(x))
    longest = F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(longest.isin(*NOISE_TITLES) | (F.length(longest) < 5), "").otherwise(longest)


def title_rank(title: Column) -> Column:
    """By which the best of several titles is chosen: the cleaned length, or the raw one if nothing is left."""
    cleaned = F.length(clean_title(title))
    return F.when(cleaned > 0, cleaned).otherwise(F.length(F.coalesce(title, F.lit(""))))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, of three or more, that are no query stopwords; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_ ]", " "), " +")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*QUERY_STOPWORDS))


def content_words(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def clean_topic(topic: Column) -> Column:
    """Leading articles and pronouns off."""
    words = F.split(F.trim(topic), r"\s+")
    first = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.when(a.on & F.lower(w).isin(*LEADING_NOISE), F.struct((a.n + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a.n.alias("n"), F.lit(False).alias("on"))), lambda a: a.n)
    return F.array_join(F.slice(words, first + 1, F.greatest(F.lit(0), F.size(words) - first)), " ")


def stopword_ratio(topic: Column) -> Column:
    words = F.filter(F.split(F.lower(topic), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.size(F.filter(words, lambda w: w.isin(*TOPIC_STOPWORDS))) / F.size(words))


def keep_topics(topics: Column) -> Column:
    """Topics that name something: no host names, URLs, names of companies, short ones or chatter."""
    proper = lambda t: t.rlike(r"^[A-Z]\S*(\s+[A-Z]\S*)+$") & t.rlike(r"(^|\s)[A-Z][a-z]")
    kept = F.filter(topics, lambda t: ~t.contains(".") & ~proper(t) & ~t.rlike(r"[/\\?=&]"))
    return F.filter(F.transform(kept, clean_topic), lambda t: (F.length(t) >= 2) & (stopword_ratio(t) < 0.5))


def slug(text: Column, limit: int, default: str) -> Column:
    """Lower case, letters and digits joined by single dashes, cut to the limit."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    x = F.regexp_replace(F.substring(x, 1, limit), "-+$", "")
    return F.when(x == "", default).otherwise(x)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_cell(text: Column) -> Column:
    """For a cell of a markdown table."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def escape_wikilink(text: Column) -> Column:
    return F.regexp_replace(text, r"[\[\]|#^]", "")


def escape_yaml(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def period(hour: Column) -> Column:
    return F.when(hour < 12, "Morning").when(hour < 17, "Afternoon").otherwise("Evening")


def hour_label(hour: Column) -> Column:
    return F.when(hour % 24 == 0, "12am").when(hour < 12, F.concat(hour.cast("string"), F.lit("am"))).when(hour == 12, "12pm").otherwise(F.concat((hour - 12).cast("string"), F.lit("pm")))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def escape_markdown(text: Column) -> Column:
    """For a list item or paragraph: no terminal colours, tags, accidental #tags or fields::."""
    x = F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", "")
    x = F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    x = F.regexp_replace(x, r"(^|[\s(\[])#(?=[A-Za-z])", r"$1\\#")
    return F.replace(x, F.lit("::"), F.lit(":\u200b:"))


def escape_link_text(text: Column) -> Column:
    return F.regexp_replace(escape_markdown(text), r"([\[\]])", r"\\$1")


def escape_table_cell(text: Column) -> Column:
    return F.replace(escape_markdown(text), F.lit("|"), F.lit("\\|"))


def escape_inline(text: Column) -> Column:
    """For text between markers of bold or italics."""
    return F.regexp_replace(text, r"[*_`\[\]]", "")


def quote_yaml(value: Column) -> Column:
    """In double quotes if it has a character that YAML gives a meaning."""
    special = value.rlike(r"""[:{}\[\]#&*!|>'"%@`,?\r\n]""") | value.contains("---")
    return F.when(special, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)
