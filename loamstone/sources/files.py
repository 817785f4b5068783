"""Readers of text trees, dumps and side files; all of them Spark sources, so paths may be of any store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone import schema
from loamstone.functions.sources import is_blocked, site_of
from loamstone.functions.text import drop_replacement

TEXT_SUFFIXES = ("txt", "md", "rst")
#: Directories that are not read.
SKIP_DIRS = (
    "dumps", ".git", "__pycache__", "node_modules", "tests", ".venv",
    "processed", "github", "Documentation", "drivers", "tools",
)
#: Suffixes of project files.
CODE_SUFFIXES = (
    "py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs",
    "go", "rs", "java", "kt", "rb", "php", "cs", "cpp", "h", "hpp",
    "sh", "bash", "zsh", "yaml", "yml", "toml", "json", "md", "txt",
    "sql", "graphql", "vue", "svelte",
)
#: Project directories that are not read.
PROJECT_SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build",
    "lancedb_index", "data/processed", "data/dumps", "data/mdn-web-docs",
    ".cursor", "target", "vendor", ".next", ".cache",
)
#: Folders whose files are indexed as they are.
PASSTHROUGH = ("gutenberg", "linux-docs")
MAX_PROJECT_BYTES = 512 * 1024


def _glob(suffixes) -> str:
    return "*.{" + ",".join(suffixes) + "}"


def _outside(path, folders):
    out = F.lit(True)
    for f in folders:
        out = out & ~path.contains(f"/{f}/")
    return out


def text_tree(spark: SparkSession, path: str, suffixes=TEXT_SUFFIXES, skip=SKIP_DIRS) -> DataFrame:
    """source (the file), text of every text file below path, undecodable bytes dropped."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=_glob(suffixes))
    named = files.select(F.col("_metadata.file_path").alias("source"), drop_replacement(F.col("value")).alias("text"))
    return named.where(_outside(F.col("source"), skip))


def priority_text(spark: SparkSession, path: str, roots, blocked=()) -> DataFrame:
    """Only the files below the given roots of path whose source is not blocked; roots that are not there are left out."""
    return text_tree(spark, f"{path}/{{{','.join(roots)}}}").where(~is_blocked(F.col("source"), blocked))


def passthrough_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts that need no preparation, read from where they are."""
    return priority_text(spark, path, PASSTHROUGH)


def project_files(spark: SparkSession, path: str, max_bytes: int = MAX_PROJECT_BYTES) -> DataFrame:
    """source, text of code files of up to max_bytes; larger ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(CODE_SUFFIXES)).load(path)
    small = files.where((F.col("length") <= max_bytes) & _outside(F.col("path"), PROJECT_SKIP_DIRS))
    text = drop_replacement(F.col("content").cast("string"))
    return small.select(F.concat(F.lit("user:"), "path").alias("source"), text.alias("text"))


def elements(spark: SparkSession, path, tag: str, closing: str, row: T.StructType) -> DataFrame:
    """file, x: the elements of a name in XML files, parsed by a schema; null where one is malformed.

    The text reader cuts files where an element begins, so a file, or one packed by bzip2, is as many tasks as it has
    splits, and an element over the end of a split belongs to the one in which it begins; gzip can only be read as a whole. What begins an
    element cannot stand in a text or an attribute, where `<` is escaped. closing: a pattern up to the end of an element;
    one without its end, as in a dump that was cut off, is left out.
    """
    parts = spark.read.option("lineSep", f"<{tag}").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    # What follows a name that only starts like this one, and what stands before the first element, is none.
    inside = F.regexp_extract("value", rf"(?s)\A([\s/>]{closing})", 1)
    whole = parts.select("file", F.concat(F.lit(f"<{tag}"), inside).alias("value")).where(F.length("value") > len(tag) + 1)
    return whole.select("file", F.from_xml("value", row, {"rowTag": tag}).alias("x"))


def wiki_dump(spark: SparkSession, path) -> DataFrame:
    """title, text of the pages of a (compressed) dump."""
    return elements(spark, path, "page", ".*?</page\\s*>", schema.WIKI_PAGE).select("x.title", F.col("x.revision.text").alias("text"))


def post_rows(spark: SparkSession, path) -> DataFrame:
    """file and the columns of the rows of Posts.xml files."""
    return elements(spark, path, "row", ".*(?:/>|</row\\s*>)", schema.POST).select("file", "x.*")


def posts(spark: SparkSession, path) -> DataFrame:
    """The rows of Posts.xml files with the site, the folder that holds the file."""
    return post_rows(spark, path).withColumn("site", site_of(F.col("file"))).drop("file")


def site_posts(spark: SparkSession, root: str) -> DataFrame:
    """The posts of every site, a folder of root: of its Posts.xml, or else of the first one in its folders. One path a site is listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "Posts.xml").load(root).select("path")
    inside = F.element_at(F.split("path", re.escape("/" + root.rstrip("/").rpartition("/")[2] + "/"), 2), 2)
    site = F.substring_index(inside, "/", 1)
    nested = inside != F.concat(site, F.lit("/Posts.xml"))
    first = found.groupBy(site.alias("site")).agg(F.min(F.struct(nested, "path"))["path"].alias("path"))
    paths = {r["path"]: r["site"] for r in first.collect()}
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.POST.fields, T.StructField("site", T.StringType())]))
    names = F.create_map(*[F.lit(x) for p, s in paths.items() for x in (p.partition(":")[2].lstrip("/"), s)])
    key = F.regexp_replace("file", "^[a-z0-9]+:/+", "")
    return post_rows(spark, list(paths)).withColumn("site", names[key]).drop("file")


def api_items(spark: SparkSession, path: str) -> DataFrame:
    """Saved answers of a question API, an item a row."""
    kind = "items array<" + schema.API_ITEM.simpleString() + ">"
    return spark.read.option("multiLine", True).schema(kind).json(path).select(F.inline("items"))


def jsonl_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, text string").json(path)


def tenants(spark: SparkSession, path: str) -> DataFrame:
    kind = "tenants array<" + schema.TENANT.simpleString() + ">"
    raw = spark.read.option("multiLine", True).schema(kind).json(path).select(F.inline("tenants"))
    return raw.fillna(schema.TENANT_DEFAULTS)


def collector_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema.COLLECTOR_STATE).json(path)


def artefacts(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of release files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A chunk table, or the named columns of it alone."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_live_hits(hits: DataFrame, live: DataFrame, engine: str) -> DataFrame:
    """hits and the results of a live search (title, text, _distance), labelled as such."""
    label = F.concat(F.lit(f"live:{engine}:"), "title")
    return hits.select("source", "text", "_distance").unionByName(live.select(label.alias("source"), "text", "_distance"))
