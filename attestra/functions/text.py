"""Text, number and hash functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing, and the section names that are headings by themselves.
MISSING = ("", "unknown", "tbd", "unspecified", "미확인")
SECTIONS = (
    "abstract", "introduction", "background", "related work", "method", "methodology", "approach", "experiment", "experiments",
    "result", "results", "discussion", "limitation", "limitations", "conclusion", "future work", "appendix",
)
NUMBERED = r"([0-9]+(\.[0-9]+)*\s+)?"  # a section number that may stand before a heading
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this")
# Marks of money, scale and growth in a claim.
MONEY_OR_SCALE = r"(?i)([$€₩%]|million|billion|\busd\b|달러|억|조\s*원|성장률|매출)"


def normalize_text(x: Column) -> Column:
    """NUL to space, line ends to LF, runs of blanks to one, three LF and more to two, ends stripped."""
    x = F.regexp_replace(F.regexp_replace(x, "\x00", " "), "\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, r"^[ \n]+", ""), r"[ \n]+$", "")


def fold_text(x: Column) -> Column:
    """White space runs to one space, ends stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def token_count(x: Column) -> Column:
    """Words and single other characters."""
    return F.size(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).cast("long")


def is_heading(x: Column) -> Column:
    """Lines of up to 100 characters that are a section name or all capitals, numbered or not, or any words with a number."""
    named = F.lower(x).rlike(f"^{NUMBERED}({'|'.join(SECTIONS)})\\s*$")
    capitals = x.rlike(f"^{NUMBERED}[A-Z][A-Z\\s&:/-]{{3,}}$")
    return (F.length(x) <= 100) & (named | capitals | x.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+[A-Za-z].+$"))


def content_hash(x: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(x, 256), 1, length)


def stable_id(*parts: Column, length: int = 24) -> Column:
    """A digest of parts joined by the unit separator."""
    return content_hash(F.concat_ws("\x1f", *parts), length)


def numeric_tokens(x: Column) -> Column:
    """Distinct numbers that are no part of an identifier; grouped thousands lose their commas."""
    found = F.regexp_extract_all(x, F.lit(r"(?:^|[^A-Za-z0-9_.,-])([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, ",", ""))))


def lexical_terms(x: Column) -> Column:
    """Lower-case words of three letters and more without stop words; words over four letters also without a plural s."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))
    singular = F.transform(F.filter(words, lambda w: (F.length(w) > 4) & w.endswith("s")), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))
    return F.array_sort(F.array_union(words, singular))


def is_missing(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*MISSING)


def quantitative_claim(x: Column) -> Column:
    return x.rlike("[0-9]") & x.rlike(MONEY_OR_SCALE)


def visible_text(x: Column) -> Column:
    """Link text only, bare URLs removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"https?://\S+", ""))


def redact(x: Column) -> Column:
    """Credential-like values are masked."""
    x = F.regexp_replace(x, r"AKIA[A-Z0-9]{12,}", "[REDACTED]")
    x = F.regexp_replace(x, r"(?i)(password|secret|token|api_?key)([\"']? *[:=] *[\"']?)[A-Za-z0-9+/_.=-]{8,}", "$1$2[REDACTED]")
    return F.regexp_replace(x, r"[0-9a-f]{32,}", "[REDACTED]")


def url_host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))


def canonical_url(x: Column) -> Column:
    """Scheme and host in lower case, no fragment, an empty path as /; other paths and the query are kept."""
    bare = F.regexp_replace(x, "#.*$", "")
    rest = F.regexp_replace(bare, r"^https?://[^/?]+", "")
    return F.concat(F.lower(F.regexp_extract(bare, r"^(https?://[^/?]+)", 1)), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


# Names and addresses that are not public, as prefixes of the IPv4 blocks or whole names.
LOCAL_NAMES = r"(^|\.)(localhost|local|internal)\.?$"
LOCAL_BLOCKS = (
    r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.[0-9]+\.[0-9]+\.[0-9]+$|^169\.254\.[0-9]+\.[0-9]+$|^172\.(1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+$"
    r"|^192\.168\.[0-9]+\.[0-9]+$|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9]+\.[0-9]+$|^192\.0\.[02]\.[0-9]+$|^198\.(1[89]\.[0-9]+|51\.100)\.[0-9]+$|^203\.0\.113\.[0-9]+$"
)


def public_url(x: Column) -> Column:
    """http(s), a dotted host that is neither a local name nor in a private or reserved IPv4 block, no credentials.

    An IPv6 host in brackets has no dotted name and does not pass."""
    host = url_host(x)
    return x.rlike("^https?://") & ~x.rlike("^https?://[^/?#]*@") & host.contains(".") & ~host.rlike(LOCAL_NAMES) & ~host.rlike(LOCAL_BLOCKS) & ~host.startswith("[")


def markdown_escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([\\|*_`])", r"\\$1"), "\n", " ")


def sentences(x: Column) -> Column:
    """Sentences of a text: cut after . ! ? before white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(x, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def number_range(low: Column, high: Column, unit: str) -> Column:
    return F.when(low.isNull() & high.isNull(), F.lit(None)).when(low.isNull(), F.concat(F.lit("≤"), high.cast("string"), F.lit(f" {unit}"))).when(high.isNull(), F.concat(F.lit("≥"), low.cast("string"), F.lit(f" {unit}"))).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string"), F.lit(f" {unit}")))
