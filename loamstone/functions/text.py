"""Scalar functions on text; all are Column expressions but the one marked as an Arrow UDF."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a Unicode strip removes: white space and the four separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
#: What html.unescape takes for a reference, without its ampersand.
_REFERENCE = r"\A(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The entities of unescape_named, in the order in which they are decoded.
ENTITIES = (("middot", "\u00b7"), ("copy", "\u00a9"), ("quot", '"'), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def head(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def contains_any(text: Column, tokens) -> Column:
    """Whether text contains one of a fixed list of tokens."""
    out = F.lit(False)
    for t in tokens:
        out = out | text.contains(t)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded(references: pd.Series) -> pd.Series:
    """Each of a list of references decoded; the full entity table exists in Python only (Arrow UDF)."""
    return references.map(lambda row: [html.unescape(r) for r in row], na_action="ignore")


def unescape_html(text: Column) -> Column:
    """Entities decoded once, as html.unescape does. Only the references go to Python, not the texts that hold them."""
    pieces = F.split(text, "&", -1)  # what follows each ampersand may begin with a reference
    after = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    reference = lambda x: F.concat(F.lit("&"), F.regexp_extract(x, _REFERENCE, 1))
    # Not deterministic as far as the optimizer knows, so that a filter on the text does not decode once more.
    decoded = _decoded.asNondeterministic()(F.transform(after, reference))
    rest = lambda x, d: F.concat(d, F.regexp_replace(x, _REFERENCE, ""))
    return F.when(text.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(after, decoded, rest), ""))).otherwise(text)


def unescape_named(text: Column, names=ENTITIES) -> Column:
    """A few entities decoded, each named in full up to its semicolon; &amp; comes last, so what it yields is not decoded again."""
    for name, character in names:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    return text


def strip_html(text: Column, unescape=unescape_html) -> Column:
    """Entities are decoded before tags go, so escaped markup goes too."""
    return collapse_space(F.regexp_replace(unescape(text), "<[^>]+>", " "))


def drop_replacement(text: Column) -> Column:
    """Text read leniently: undecodable bytes, which the regular expression sees as U+FFFD, are dropped."""
    return F.regexp_replace(text, "\ufffd", "")


def tag_list(tags: Column) -> Column:
    """`<a><b>` as `a b ` (the last blank stays)."""
    return F.replace(F.replace(F.coalesce(tags, F.lit("")), F.lit("<"), F.lit("")), F.lit(">"), F.lit(" "))


def post_text(title: Column, tags: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\nTags: "), tag_list(tags), F.lit("\n\n"), body)


def titled(title: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), text)


def safe_filename(title: Column) -> Column:
    return head(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_"), 100)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def detected_mode(question: Column) -> Column:
    """The mode that a question's words suggest, by rules of our own."""
    q = F.lower(question)
    return (
        F.when(contains_any(q, ("security audit", "vulnerab", "cve-")), "audit")
        .when(contains_any(q, ("review this", "review my", "code review")), "review")
        .when(contains_any(q, ("```", "write a function", "write a script", "implement ")), "code")
        .otherwise("support")
    )


def mode_of(query: Column, detect: bool = False) -> tuple[Column, Column]:
    """(mode, question) of `/mode question`; without one support or, if asked, what is detected."""
    pattern = r"(?s)^/(code|review|audit|support)\s+(.*)$"
    named = query.rlike(pattern)
    return (
        F.when(named, F.regexp_extract(query, pattern, 1)).otherwise(detected_mode(query) if detect else F.lit("support")),
        F.when(named, F.regexp_extract(query, pattern, 2)).otherwise(query),
    )


def version_key(version: Column) -> Column:
    """The first three dotted numbers; arrays compare as tuples do, a shorter prefix first."""
    return F.transform(F.slice(F.split(version, r"\."), 1, 3), lambda x: x.cast("int"))


def guarded_rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
