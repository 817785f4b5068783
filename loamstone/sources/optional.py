"""Readers that need a library which may be absent: PDF pages and wikitext."""

from __future__ import annotations

import importlib.util
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _has(name: str) -> bool:
    return importlib.util.find_spec(name) is not None


@F.pandas_udf(T.StringType())
def _pdf_text(content: pd.Series) -> pd.Series:
    from pypdf import PdfReader

    def pages(data: bytes) -> str | None:
        try:
            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
        except Exception:
            return None  # a damaged file gives no text, as a failed page does elsewhere

    return content.map(pages)


def pdf_texts(spark: SparkSession, path: str, min_chars: int = 100) -> DataFrame:
    """source, text of PDF files, pages joined by line ends; texts of min_chars or fewer are dropped."""
    if not _has("pypdf"):
        raise ImportError("reading PDF files needs the library pypdf")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    texts = files.select(F.col("path").alias("source"), _pdf_text("content").alias("text"))
    return texts.where(F.length("text") > min_chars)


@F.pandas_udf(T.StringType())
def _strip_code(text: pd.Series) -> pd.Series:
    import mwparserfromhell

    return text.map(lambda t: mwparserfromhell.parse(t).strip_code(), na_action="ignore")


def plain_wikitext(text: Column) -> Column:
    """Wikitext without its markup, or unchanged where the library is absent."""
    return _strip_code(text) if _has("mwparserfromhell") else text
