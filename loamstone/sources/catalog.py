"""Curated sources as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source roots by priority.
SOURCE_ROOTS = (
    "custom_docs",
    "manpages",
    "stackoverflow",
    "stackexchange",
    "rfcs",
    "mdn-web-docs/files",
    "tldr-pages/pages",
    "arch-wiki",
    "official-docs",
    "owasp",
    "wikipedia",
    "linux-docs",
    "textbooks",
)
#: Path prefixes that are never indexed.
EXCLUDED_PREFIXES = ("gutenberg", "books", "processed", "dumps", "wikisource", "wiktionary", "wikiquote", "wikiversity")
#: Question sites, small and good ones first.
QUESTION_SITES = (
    "security.stackexchange.com",
    "serverfault.com",
    "unix.stackexchange.com",
    "dba.stackexchange.com",
    "codereview.stackexchange.com",
    "devops.stackexchange.com",
    "networkengineering.stackexchange.com",
    "datascience.stackexchange.com",
    "ai.stackexchange.com",
    "raspberrypi.stackexchange.com",
    "arduino.stackexchange.com",
    "electronics.stackexchange.com",
    "webmasters.stackexchange.com",
    "ethereum.stackexchange.com",
    "wordpress.stackexchange.com",
    "superuser.com",
    "askubuntu.com",
    "softwareengineering.stackexchange.com",
    "stackoverflow.com",
)
#: Dumps of the smaller projects and of whole encyclopedias: name, name in the dumps' addresses, size.
OPTIONAL_DUMPS = (
    ("Wikibooks DE", "dewikibooks", "~50 MB"),
    ("Wikibooks EN", "enwikibooks", "~400 MB"),
    ("Wikiversity DE", "dewikiversity", "~30 MB"),
    ("Wikiversity EN", "enwikiversity", "~100 MB"),
    ("Wikisource DE", "dewikisource", "~500 MB"),
    ("Wikisource EN", "enwikisource", "~3 GB"),
    ("Wiktionary DE", "dewiktionary", "~250 MB"),
    ("Wiktionary EN", "enwiktionary", "~1.5 GB"),
)
FULL_DUMPS = (
    ("Wikipedia DE", "dewiki", "~7.6 GB"),
    ("Wikipedia EN", "enwiki", "~23 GB"),
    ("Wikipedia FR", "frwiki", "~9 GB"),
    ("Wikipedia ES", "eswiki", "~5 GB"),
)
#: Limits of a crawl: topics waiting, topics done, pages to a tag.
MAX_QUEUE, MAX_DONE, PAGES_A_TAG = 3_000, 25_000, 30


def ordered(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"ord int, {name} string").select(name, "ord")


def wiki_dumps(spark: SparkSession, *, full: bool = False) -> DataFrame:
    """name, wiki, size, url, file, ord of the dumps: the optional ones, or the encyclopedias, whose dumps are multistream."""
    rows = [(i, *row) for i, row in enumerate(FULL_DUMPS if full else OPTIONAL_DUMPS)]
    made = spark.createDataFrame(rows, "ord int, name string, wiki string, size string")
    end = "-latest-pages-articles-multistream.xml.bz2" if full else "-latest-pages-articles.xml.bz2"
    url = F.concat(F.lit("https://dumps.wikimedia.org/"), "wiki", F.lit("/latest/"), "wiki", F.lit(end))
    return made.select("name", "wiki", "size", url.alias("url"), F.concat("wiki", F.lit("-articles.xml.bz2")).alias("file"), "ord")


def capped(state: DataFrame, queue: int = MAX_QUEUE, done: int = MAX_DONE) -> DataFrame:
    """The collector's state with its first `queue` waiting topics and the last `done` finished ones."""
    last = F.slice("wiki_done", F.greatest(F.size("wiki_done") - done, F.lit(0)) + 1, done)
    return state.withColumns({"wiki_queue": F.slice("wiki_queue", 1, queue), "wiki_done": last})


def tag_pages(state: DataFrame, tags: list[str], most: int = PAGES_A_TAG) -> DataFrame:
    """tag, page: the next page of each tag that has not reached the last one."""
    rows = state.select(F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag"), "so_progress")
    page = F.coalesce(F.element_at("so_progress", F.col("tag")), F.lit(0)) + 1
    return rows.select("tag", page.cast("int").alias("page")).where(F.col("page") <= most)


def prioritised(files: DataFrame, spark: SparkSession) -> DataFrame:
    """files (path relative to the data folder) under a source root and not excluded, with the root's priority."""
    roots, excluded = ordered(spark, SOURCE_ROOTS, "root"), ordered(spark, EXCLUDED_PREFIXES, "prefix")
    # Both tables are the constants above.
    kept = files.join(F.broadcast(excluded), files["path"].startswith(excluded["prefix"]), "left_anti")
    under = kept.join(F.broadcast(roots), F.startswith(F.col("path"), F.concat("root", F.lit("/"))))
    return under.select("path", "root", "ord")
