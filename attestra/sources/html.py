"""HTML scan in built-in functions: text without chrome, and metadata by precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROME = "script|style|nav|footer|aside|noscript|template|form"


def visible(html: Column) -> Column:
    """Text outside script, style, navigation and the like; tags become spaces, runs of white space one space."""
    x = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in CHROME.split("|"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    """The first of h1, og:title and title that is not empty."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    return F.coalesce(
        clean(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)),
        clean(F.regexp_extract(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)),
        clean(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)),
    )
