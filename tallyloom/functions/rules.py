"""Ordered rules: task types, topics, intents, entities, commits. The first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(pattern: str) -> str:
    """A pattern between word boundaries by ASCII letters, digits and underscores, without lookaround."""
    return rf"(?i)(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)"


#: What a prompt asks for.
TASK_TYPES = (
    (word(r"fix|debug|why\s+(does|is|isn'?t)|not\s+work|error|crash|bug|broken|fail"), "debugging"),
    (word(r"review|check|audit|is\s+this\s+(correct|right|good)|critique|look\s+at"), "review"),
    (word(r"explain|describe|what\s+is|what\s+are|how\s+does|help\s+me\s+understand|teach|clarify"), "learning"),
    (word(r"design|plan|should\s+i|what\s+approach|architecture|structure|how\s+should\s+i\s+(design|structure|organize)"), "architecture"),
    (word(r"add|build|create|implement|write|refactor|update|generate|set\s+up|migrate"), "implementation"),
)
#: Topics of prompts and commits.
PROMPT_TOPICS = (
    (word(r"oauth|auth|jwt|token|session|login|password|credential|permission|role|access"), "authentication"),
    (word(r"react|vue|angular|svelte|next\.?js|remix|component|hook|state|props|jsx|tsx"), "frontend"),
    (word(r"api|rest|graphql|endpoint|route|http|request|response|fetch|axios|webhook"), "api-design"),
    (word(r"docker|kubernetes|k8s|terraform|aws|cloud|deploy|ci|cd|pipeline|helm|ecs"), "infrastructure"),
    (word(r"test|spec|mock|vitest|jest|coverage|unit|integration|e2e|assert|expect"), "testing"),
    (word(r"sql|database|postgres|mysql|sqlite|query|schema|migration|index|orm|prisma"), "database"),
    (word(r"typescript|type|interface|generic|infer|narrowing|zod|validation"), "typescript"),
    (word(r"performance|optimize|slow|latency|memory|cache|cdn|bundle|profil"), "performance"),
    (word(r"security|vuln|xss|csrf|injection|sanitize|escape|encrypt|hash"), "security"),
    (word(r"git|commit|branch|merge|rebase|conflict|pr|pull\s+request|review"), "version-control"),
    (word(r"algorithm|data\s+structure|complexity|sort|search|tree|graph|dynamic\s+programming"), "algorithms"),
    (word(r"machine\s+learning|llm|ai|model|embedding|vector|neural|gpt|claude|anthropic"), "ai-ml"),
    (word(r"refactor|clean|solid|pattern|architecture|design|monolith|microservice|domain"), "software-design"),
    (word(r"error|exception|crash|stack\s+trace|debug|log|monitor|alert|incident"), "debugging"),
    (word(r"doc|readme|comment|jsdoc|api\s+spec|openapi|swagger|markdown"), "documentation"),
)
#: Topics of searches, before those of prompts.
SEARCH_TOPICS = (
    (word(r"outfits?|styles?|fashion|costumes?|wear|clothing|dress(?:es)?"), "fashion"),
    (word(r"maps?|directions?|routes?|navigation|near\s+me|distance"), "navigation"),
    (word(r"events?|calendar|conference|meetups?|tickets?|concerts?|talks?|schedule"), "event-planning"),
    (word(r"jobs?|career|salary|hire|interview|resume|position|engineer|developer"), "job-search"),
    (word(r"weather|forecast|temperature"), "weather"),
    (word(r"recipes?|food|restaurants?|cook|meal|ingredient"), "food"),
    (word(r"buy|price|reviews?|amazon|deals?|shipping|shops?"), "shopping"),
    (word(r"health|symptoms?|medical|medicine|doctor|treatment"), "health"),
    (word(r"news|articles?|latest|update|breaking"), "news"),
    *PROMPT_TOPICS,
)
#: What a search is for.
INTENTS = (
    (r"(?i)(^|[^A-Za-z0-9_])((vs|compare|difference|versus)([^A-Za-z0-9_]|$)|alternative)", "compare"),
    (word(r"how\s+to|example|tutorial|guide"), "implement"),
    (word(r"best|review|recommend|pros|cons"), "evaluate"),
    (r"(?i)(^|[^A-Za-z0-9_])((what\s+is|who\s+is)([^A-Za-z0-9_]|$)|defin)", "read"),
    (r"(?i)(^|[^A-Za-z0-9_])((error|fix|debug)([^A-Za-z0-9_]|$)|not\s+work)", "troubleshoot"),
    (word(r"config|setup|install|enable|configure"), "configure"),
)
QUERY_INTENTS = ((r"(?i)(^|[^A-Za-z0-9_])(site:|(docs|github|npm|official|login|sign\s+in|download)([^A-Za-z0-9_]|$))", "navigational"), (r"(?i)^(how|what|why|when|where|who|which|can|is|does|difference\s+between|vs\.?|versus|explain)", "informational"))
#: Activity by category, and by task type.
ACTIVITIES = {"dev": "implementation", "work": "admin", "research": "research", "news": "browsing", "social": "communication", "media": "browsing", "shopping": "browsing", "finance": "admin", "ai_tools": "implementation", "personal": "browsing", "education": "learning", "health": "browsing", "travel": "browsing", "gaming": "browsing", "writing": "writing", "pkm": "writing", "other": "unknown"}
TASK_ACTIVITIES = {"implementation": "implementation", "debugging": "debugging", "review": "implementation", "learning": "learning", "architecture": "planning"}
CATEGORY_TOPICS = {"dev": "software development", "work": "work productivity", "social": "social networking", "shopping": "online shopping", "finance": "financial management", "research": "research", "news": "news and media", "media": "media consumption", "education": "education", "ai_tools": "AI tools", "health": "health and fitness", "travel": "travel planning"}
CATEGORY_SUMMARIES = {"dev": "Working in development tools", "work": "Managing work documents", "social": "Browsing social media", "shopping": "Browsing e-commerce content", "finance": "Managing financial accounts", "research": "Browsing research content", "news": "Reading news and articles", "media": "Consuming media content", "education": "Browsing educational content", "ai_tools": "Using AI tools and platforms", "health": "Tracking health and fitness activities", "travel": "Planning travel and trips", "other": "General web browsing"}
ENTITY_CATEGORIES = ("dev", "work", "research", "education", "ai_tools", "pkm", "writing")
#: Conventional commit types and their work modes; words that tell the mode otherwise, first match first.
WORK_MODES = {"feat": "building", "fix": "debugging", "refactor": "restructuring", "test": "testing", "docs": "documenting", "chore": "infrastructure", "build": "infrastructure", "ci": "infrastructure", "perf": "optimizing", "revert": "reverting", "style": "restructuring"}
MODE_WORDS = (
    (word("revert|rollback|undo"), "reverting"),
    (word("test|spec|coverage|assert|mock|fixture"), "testing"),
    (word("doc|readme|comment|documentation|changelog|license"), "documenting"),
    (word("fix(es|ed|ing)?|bug|defect|error|fault|issue|problem|crash(es|ed)?|fail(s|ed|ure)?|wrong|incorrect|broken|repair|patch|resolve[sd]?"), "debugging"),
    (word("add|implement|introduce|create|new|support|enable|allow|feature"), "building"),
    (word("refactor|clean|cleanup|reorganize|restructure|rename|move|extract|simplify|improve|optimize"), "restructuring"),
)
COMMIT = r"(?i)^(feat|fix|refactor|docs|test|chore|build|ci|perf|revert|style)(?:\(([^)]+)\))?(!)?\s*:\s*(.+)$"
#: Marks of a reason in a message, first match first. The second stands for "so" before a word that isn't one of SO_FILLERS.
WHY = (r"so\s+that", r"so\s+[A-Za-z0-9_]", "because", "since", r"in\s+order\s+to", r"to\s+avoid", "prevents?", r"fixes?\s+#[0-9]+", r"closes?\s+#[0-9]+", "addresses", "ensures?", "handles?", "otherwise")
SO_FILLERS = "far|long|much|many|good|bad|great|well|often|little|few"
GENERIC = r"(?i)^(wip|work in progress|update|updates|fix|fixes|fixed|cleanup|clean\s+up|clean|(misc|various|minor|small|quick|tiny)(\s+(fix|change|update|tweak))?|temp|tmp|temporary|changes?|changes made)$"
TECHNICAL = r"(^|[^A-Za-z0-9_])([0-9]+\.[0-9]+([^A-Za-z0-9_]|$)|[A-Za-z0-9_]+(Error|Exception)([^A-Za-z0-9_]|$)|[A-Za-z0-9_]+\(\)[A-Za-z0-9_]|#[A-Za-z0-9_]+|\.[A-Za-z0-9_]+\()"
#: Capitalised words and hosts that name no entity.
ENTITY_STOPWORDS = (
    "The", "This", "That", "How", "What", "Why", "When", "From", "With", "Here", "There", "Your", "About", "After", "Before", "Into", "Over", "Just", "Also", "More", "Some", "Such", "Each",
    "Fix", "Add", "Remove", "Update", "Refactor", "Revert", "Merge", "Bump", "Move", "Rename", "Delete", "Change", "Enable", "Disable", "Clean", "Init", "Create", "Build", "Test", "Deploy", "Release", "Improve",
    "Handle", "Pull", "Push", "Commit", "Branch", "Issue", "Draft", "Review", "Resolve", "Conflict", "Sync", "Inbox", "Unread", "Reply", "Forward", "Sent", "Subject", "Thread", "Notification", "Alert",
    "Home", "Settings", "Profile", "Dashboard", "Overview", "Summary", "Details", "Results", "Loading", "Untitled", "HTML", "CSS", "API", "URL", "SDK", "CLI", "GUI", "IDE",
)
ENTITY_SKIPPED_HOSTS = ("google.com", "maps.google.com", "maps.apple.com", "airbnb.com", "booking.com", "vrbo.com", "expedia.com", "tripadvisor.com", "mail.google.com", "outlook.live.com", "outlook.office.com", "mail.yahoo.com", "amazon.com", "adobe.com", "app.hubspot.com", "app.salesforce.com")


def first_match(text: Column, rules, default: Column | str | None) -> Column:
    out = None
    for pattern, label in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(default) if default is not None else out


def lookup(column: Column, table: dict[str, str], default: str | None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def task_type(prompt: Column) -> Column:
    return first_match(F.substring(prompt, 1, 200), TASK_TYPES, "implementation")


def prompt_topic(text: Column, default: str | None = None) -> Column:
    """A topic of the vocabulary, else the first three words of over three letters, else the default."""
    words = F.slice(F.filter(F.split(F.regexp_replace(text, r"[^A-Za-z0-9_\s-]", " "), r"\s+"), lambda w: F.length(w) > 3), 1, 3)
    return first_match(text, PROMPT_TOPICS, F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.lit(default)))


def search_topic(query: Column) -> Column:
    return first_match(query, SEARCH_TOPICS, "information")


def intent(text: Column, source: Column) -> Column:
    searched = first_match(text, INTENTS, "explore")
    return F.when(source.isin("search", "browser"), searched).when(source.isin("claude", "git"), "implement").otherwise("explore")


def query_intent(query: Column) -> Column:
    return first_match(query, QUERY_INTENTS, "transactional")


def entities(text: Column, domain: Column) -> Column:
    """The site's name, capitalised words and dashed names, in this order, without repeats, five at most."""
    domain = F.coalesce(domain, F.lit(""))
    base = F.element_at(F.split(F.regexp_replace(domain, r"\.[A-Za-z0-9_]{2,4}$", ""), r"\."), -1)
    site = F.when((domain != "") & (F.length(base) > 2), F.array(F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, 2, 1000)))).otherwise(F.array().cast("array<string>"))
    capital = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9]+(?:\.[a-zA-Z]+)?(?![A-Za-z0-9_])"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*ENTITY_STOPWORDS))
    dashed = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[a-z]+-[a-z]+(?:-[a-z]+)?(?![A-Za-z0-9_])"), F.lit(0)), lambda w: F.length(w) > 4)
    found = F.slice(F.array_distinct(F.concat(site, capital, dashed)), 1, 5)
    return F.when(domain.isin(*ENTITY_SKIPPED_HOSTS), F.array().cast("array<string>")).otherwise(found)


def commit_type(message: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(message), COMMIT, 1))


def commit_breaking(message: Column) -> Column:
    return F.regexp_extract(F.trim(message), COMMIT, 3) == "!"


def commit_description(message: Column) -> Column:
    d = F.trim(F.regexp_extract(F.trim(message), COMMIT, 4))
    return F.when(commit_type(message) != "", d).otherwise(F.trim(message))


def commit_scope(message: Column) -> Column:
    """What stands in brackets behind the type, or null."""
    x = F.trim(F.regexp_extract(F.trim(message), COMMIT, 2))
    return F.when(x != "", x)


def work_mode(message: Column, insertions: Column, deletions: Column) -> Column:
    text = F.concat(commit_description(message), F.lit(" "), message)
    ratio = insertions / F.greatest(deletions, F.lit(1))
    by_size = (
        F.when((insertions > 0) & (deletions == 0), "building").when((deletions > 0) & (insertions == 0), "restructuring")
        .when((insertions + deletions > 0) & (ratio > 3), "building").when((insertions + deletions > 0) & (ratio < 0.33), "restructuring").otherwise("tweaking")
    )
    return F.coalesce(lookup(commit_type(message), WORK_MODES, None), first_match(text, MODE_WORDS, by_size))


def why_clause(message: Column) -> Column:
    """From the first mark of a reason on, 120 characters; or null."""
    out = []
    for i, p in enumerate(WHY):
        p = rf"so\s+(?!{SO_FILLERS})[A-Za-z0-9_]" if i == 1 else p + "(?![A-Za-z0-9_])"
        at = F.regexp_instr(message, F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{p})"))
        out.append(F.when(at > 0, F.trim(F.substring(message, at, F.lit(120)))))
    return F.coalesce(*out)


def is_generic(message: Column) -> Column:
    return F.trim(message).rlike(GENERIC)


def task_title(prompt: Column) -> Column:
    """What is asked, without the verb, up to the first end of a sentence or 80 characters."""
    x = F.substring(F.coalesce(prompt, F.lit("")), 1, 200)
    x = F.regexp_replace(x, r"(?i)^(fix|debug|add|create|build|implement|write|refactor|update|review|explain|help\s+me\s+(with|understand)|how\s+do\s+i)\s+", "")
    x = F.regexp_replace(x, r"(?i)^(what\s+is|what\s+are|why\s+(does|is|isn'?t)|how\s+does)\s+", "")
    end = F.regexp_instr(x, F.lit("[?.!]"))
    return F.trim(F.when(end > 1, F.substring(x, F.lit(1), end - 1)).otherwise(F.substring(x, 1, 80)))


def interaction_mode(kind: Column) -> Column:
    return F.when(kind.isin("learning", "architecture"), "exploration").otherwise("acceleration")
