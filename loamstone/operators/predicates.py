"""Row filters: what is indexed, what is searched and which questions are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions.sources import is_blocked, is_noise
from loamstone.functions.text import contains_any, post_text, strip, strip_html
from loamstone.operators.joins import FEW_PATTERNS, dimension, few, matching

MIN_INDEX_CHARS = 30
MIN_HIT_CHARS = 25
MAX_DISTANCE = 1.35
MIN_SIMILARITY = 0.42

#: What a question may not ask for.
FORBIDDEN = (
    "rm -rf /", "rm -rf /*", "drop database", "drop table",
    "forkbomb", ":(){ :|:& };:", "format c:", "overwrite system",
    "disable firewall", "exfiltrate", "keylogger", "rootkit",
    "reverse shell", "bind shell", "malware", "ransomware",
)


def indexable(text: Column, source: Column, blocked=()) -> Column:
    return (F.length(strip(text)) >= MIN_INDEX_CHARS) & ~is_blocked(source, blocked)


def low_quality(text: Column, source: Column) -> Column:
    """Noise sources and short texts; a null text is low quality."""
    return is_noise(source) | (F.length(strip(F.coalesce(text, F.lit("")))) < MIN_HIT_CHARS)


def safe_intent(question: Column) -> Column:
    return ~contains_any(F.lower(question), FORBIDDEN)


def within_distance(distance: Column, limit: float = MAX_DISTANCE) -> Column:
    return distance <= limit


def similar_enough(similarity: Column, least: float = MIN_SIMILARITY) -> Column:
    return similarity >= least


def not_blocked(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """df without rows whose lower-cased source contains a pattern of the table, whatever its size; null sources stay."""
    if not few(patterns):
        return df.join(matching(df.select("source").distinct(), patterns), "source", "left_anti").select(*df.columns)
    return df.join(dimension(patterns, FEW_PATTERNS), F.lower(df["source"]).contains(patterns["pattern"]), "left_anti")


def wiki_pages(pages: DataFrame, *, batch: bool = True, blocked=()) -> DataFrame:
    """pages (title, text) that are articles.

    batch: a title is needed, redirects of both languages go, and so do cleaned texts of 50
    characters or fewer; otherwise only the English redirect goes and the text must be indexable.
    """
    text = F.col("text")
    long_enough = F.length(text) > 100
    if batch:
        redirect = text.startswith("#REDIRECT") | text.startswith("#WEITERLEITUNG")
        return pages.where((F.col("title") != "") & long_enough & ~redirect & (F.length(strip(text)) > 50))
    source = F.concat(F.lit("wiki:"), F.coalesce("title", F.lit("")))
    return pages.where(long_enough & ~text.startswith("#REDIRECT") & indexable(text, source, blocked))


def question_posts(posts: DataFrame, site: Column, *, min_score: int = 3, min_chars: int = 120, blocked=()) -> DataFrame:
    """posts (_Id, _PostTypeId, _Score, _Title, _Body, _Tags) -> source, text of the questions that are indexed.

    The cheap conditions stand before the Arrow UDF that decodes the bodies.
    """
    score = F.coalesce(F.try_to_number(F.nullif("_Score", F.lit("")), F.lit("S999999999")).cast("int"), F.lit(0))
    asked = posts.where((F.col("_PostTypeId") == "1") & (score >= min_score))
    text = post_text(F.col("_Title"), F.col("_Tags"), strip_html(F.coalesce("_Body", F.lit(""))))
    label = F.concat(F.lit("stackexchange:"), site)
    asked = asked.select(
        F.concat(label, F.lit(":"), F.coalesce("_Id", F.lit("?"))).alias("source"), label.alias("_site"), text.alias("text")
    )
    return asked.where((F.length("text") >= min_chars) & indexable(F.col("text"), F.col("_site"), blocked)).drop("_site")


def pruned_queue(done: Column) -> Column:
    """A list of finished topics without those to be read again."""
    return F.filter(done, lambda x: ~(x.contains("Datenschutz") | F.substring(F.lower(x), 1, 8).contains("daten")))


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first n rows, or all if n is 0."""
    return df.limit(n) if n else df
