"""Functions on source labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.functions.text import basename, contains_any, stem, strip

#: Path tokens and the class each names, in the order in which they are tried.
CLASSES = (
    ("manpages", "manpages"),
    ("stackoverflow", "stackoverflow"),
    ("rfcs", "rfcs"),
    ("tldr", "tldr"),
    ("stackexchange", "stackexchange"),
    ("owasp", "owasp"),
    ("arch-wiki", "archwiki"),
    ("official-docs", "official-docs"),
    ("mdn-web-docs", "mdn"),
    ("linux-docs", "linux"),
    ("wikipedia", "wikipedia"),
    ("gutenberg", "gutenberg"),
    ("custom_docs", "custom"),
)
#: Tokens of sources that hold images or scan noise.
NOISE_TOKENS = (".jpg", ".png", ".svg", ".gif", "seite:la2", "blitz-0")
#: Fixed value: the boost of a source that no pattern matches.
DEFAULT_BOOST = 0.95


def source_class(path: Column) -> Column:
    p = F.lower(path)
    out = None
    for token, name in CLASSES:
        fits = p.contains(token)
        if token == "wikipedia":
            fits = fits | (p.contains("processed") & p.contains("wiki"))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("other")


def is_blocked(source: Column, patterns) -> Column:
    """Whether the lower-cased source contains one of a fixed list of patterns."""
    return contains_any(F.lower(source), patterns)


def is_noise(source: Column) -> Column:
    return contains_any(F.lower(F.coalesce(source, F.lit(""))), NOISE_TOKENS)


def is_user_project(source: Column) -> Column:
    return source.startswith("user:") | F.replace(source, F.lit("\\"), F.lit("/")).contains("/projects/")


def boost(source: Column, boosts, blocked=()) -> Column:
    """0 if blocked; else that of the first pattern (pattern, boost) that the source contains."""
    s = F.lower(source)
    out = F.when(is_blocked(source, blocked), F.lit(0.0))
    for pattern, value in boosts:
        out = out.when(s.contains(pattern), F.lit(float(value)))
    return out.otherwise(F.lit(DEFAULT_BOOST))


def short(source: Column) -> Column:
    """A source as it stands in a citation."""
    s = strip(source)
    parts = F.split(s, ":")
    live = F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(s)
    return (
        F.when(s.startswith("live:"), live)
        .when(s.startswith("user:"), basename(s))
        .when(s.startswith("stackexchange:"), s)
        .when(F.length(s) > 40, stem(s))
        .otherwise(basename(s))
    )


def site_of(path: Column) -> Column:
    """The directory that holds a dump's Posts.xml."""
    return F.regexp_extract(path, r"([^/]+)/Posts\.xml$", 1)


def table_name(base: str, tenant: Column, suffix: Column) -> Column:
    return F.concat(F.lit(f"{base}_"), F.coalesce(F.when(suffix != "", suffix), tenant))
