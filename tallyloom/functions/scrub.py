"""Redaction of secrets, addresses, paths and protocol noise in text columns, in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

B = r"(?<![A-Za-z0-9_])"  # word boundaries by ASCII letters, also next to accented ones
E = r"(?![A-Za-z0-9_])"

#: Patterns and their replacements, in the order in which they apply.
SECRETS = (
    (r"(?i)(?:export\s+)?([A-Za-z0-9_]*(?:password|passwd|secret|token|key|api_?key|auth|bearer|credential)[A-Za-z0-9_]*)\s*=\s*\S+", "$1=[REDACTED]"),
    (r"(?i)(authorization:\s*(?:bearer|basic|token)\s+)\S+", "$1[REDACTED]"),
    (r"(?i)((?:postgres|mysql|mongodb|redis)://[^:]+:)[^@]+(@)", "$1[REDACTED]$2"),
    (r"AKIA[A-Z0-9]{16}", "[AWS_KEY_REDACTED]"),
    (r"ghp_[A-Za-z0-9_]{36}", "[GITHUB_TOKEN_REDACTED]"),
    (r"github_pat_[A-Za-z0-9_]{22}_[A-Za-z0-9_]{59}", "[GITHUB_TOKEN_REDACTED]"),
    (r"gho_[A-Za-z0-9_]{36}", "[GITHUB_TOKEN_REDACTED]"),
    (r"sk-ant-[A-Za-z0-9_-]{20,}", "[ANTHROPIC_KEY_REDACTED]"),
    (r"sk-[A-Za-z0-9]{20,}", "[OPENAI_KEY_REDACTED]"),
    (r"xox[bpras]-[A-Za-z0-9-]{10,}", "[SLACK_TOKEN_REDACTED]"),
    (r"npm_[A-Za-z0-9]{36}", "[NPM_TOKEN_REDACTED]"),
    (r"[sr]k_(?:live|test)_[A-Za-z0-9]{20,}", "[STRIPE_KEY_REDACTED]"),
    (r"pk_(?:live|test)_[A-Za-z0-9]{20,}", "[STRIPE_KEY_REDACTED]"),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "[JWT_REDACTED]"),
    (r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", "[SENDGRID_KEY_REDACTED]"),
    (r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+)?PRIVATE\s+KEY-----", "[PRIVATE_KEY_REDACTED]"),
    (B + r"[0-9a-fA-F]{40,}" + E, "[HEX_TOKEN_REDACTED]"),
    (B + r"(?:4[0-9]{3}(?:[ -]?[0-9]{4}){3}|5[1-5][0-9]{2}(?:[ -]?[0-9]{4}){3}|6(?:011|5[0-9]{2})(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3(?:0[0-5]|[68][0-9])[0-9][ -]?[0-9]{6}[ -]?[0-9]{4})" + E, "[CREDIT_CARD_REDACTED]"),
    (B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + E, "[SSN_REDACTED]"),
)
#: The first pattern in a form that looks at each word once: where it can begin is said first, and that an equals sign follows.
BY_WORD = SECRETS[0][0].replace(r"(?:export\s+)?", r"(?:export\s+|(?<![A-Za-z0-9_]))(?=[A-Za-z0-9_]++\s*+=)")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP = B + rf"(?:{OCTET}\.){{3}}{OCTET}" + E
HOME = r"(?:/Users/[^/\s]+|/home/[^/\s]+)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"


def apply(text: Column, rules) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def secrets(text: Column) -> Column:
    return apply(text, ((BY_WORD, SECRETS[0][1]), *SECRETS[1:]))


def ips(text: Column) -> Column:
    return F.regexp_replace(text, IP, "[IP_REDACTED]")


def home_paths(text: Column) -> Column:
    return F.regexp_replace(text, HOME, "~")


def emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[EMAIL]")


def text(column: Column) -> Column:
    return emails(home_paths(ips(secrets(column))))


def markup_artifacts(column: Column) -> Column:
    """Screenshots, abort marks, terminal colours and runs of empty lines go."""
    return F.trim(apply(column, ((r"(?s)<image>.*?</image>", ""), ("</image>", ""), (r"<turn_aborted\s*/?>", ""), (ANSI, ""), (r"\n{3,}", "\n\n"))))


def leaks(column: Column) -> Column:
    """How many spans of secrets a text still has; those with 'test' or 'fake' in them, and what is already redacted, don't count."""
    found = F.concat(*[F.regexp_extract_all(column, F.lit(p), F.lit(0)) for p, _ in SECRETS[1:]])
    return F.size(F.filter(found, lambda x: ~F.lower(x).rlike(r"test|fake|\[redacted")))


#: Names of tools that a text of tier 4 must not have.
TOOLS = ("github", "npm", "git", "slack", "aws", "docker", "kubernetes", "jenkins", "gitlab", "bitbucket", "jira", "notion", "asana", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "terraform", "ansible", "vagrant", "docker-compose")


def tier_violations(column: Column) -> Column:
    """What a text of tier 4 has that it must not: of urls, paths, tools."""
    kinds = {"urls": r"(?i)https?://\S+", "paths": r"/\S+|[A-Z]:\\\S+", "tools": f"(?i){B}(?:{'|'.join(TOOLS)}){E}"}
    return F.filter(F.array(*[F.when(column.rlike(p), F.lit(k)) for k, p in kinds.items()]), lambda x: x.isNotNull())
