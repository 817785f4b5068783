"""Queries of readers and writers: tables are written in the shapes that the engine reads, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.operators import joins, predicates
from loamstone.plans.corpus import STRIP
from loamstone.plans.registry import folder, query, table
from loamstone.sources import build, catalog, files, sinks, versions


@query("""SELECT n_nationkey, n_name || chr(10) AS text FROM nation""")
def text_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of text files, one a nation, and another that is skipped."""
    path, nations = folder(spark, "tree"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for place in ("docs", "node_modules"):
        nations.write.partitionBy("n_nationkey").text(f"{path}/{place}")
    key = F.regexp_extract("source", r"n_nationkey=(\d+)", 1).cast("int")
    return files.text_tree(spark, path).select(key.alias("n_nationkey"), "text")


@query("""SELECT n_nationkey, 'user:' AS kind, n_name || chr(10) AS text FROM nation WHERE length(n_name) <= 8""")
def project_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree as a project's files, none of more than nine bytes."""
    path = folder(spark, "project")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(f"{path}/src")
    found = files.project_files(spark, path, max_bytes=9)
    key = F.regexp_extract("source", r"n_nationkey=(\d+)", 1).cast("int")
    return found.select(key.alias("n_nationkey"), F.substring("source", 1, 5).alias("kind"), "text")


@query("""SELECT source, sha256(text) AS text_sha256 FROM documents""")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "documents"), path)
    return files.jsonl_chunks(spark, path).select("source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _dealt(df: DataFrame, rows: int = 5000) -> DataFrame:
    """df in tasks of so many rows: a row of a few bytes may become a long text, so the bytes that are read do not tell the work."""
    return df.repartition(max(1, -(-df.count() // rows)))


@query("""SELECT p_partkey || ' ' || p_name AS title, sha256(t) AS text_sha256 FROM (
  SELECT *, CASE p_size % 7 WHEN 1 THEN '#REDIRECT ' WHEN 2 THEN '#WEITERLEITUNG ' ELSE '' END || repeat(p_name || ' & <' || p_brand || '> ', p_size) || '.' AS t FROM part
) WHERE length(t) > 100 AND p_size % 7 NOT IN (1, 2)""")
def wiki_dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of a compressed dump: redirects and short ones are no articles."""
    path, part = folder(spark, "dump"), _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    prefix = F.expr("CASE p_size % 7 WHEN 1 THEN '#REDIRECT ' WHEN 2 THEN '#WEITERLEITUNG ' ELSE '' END")
    text = F.concat(prefix, F.expr("repeat(concat(p_name, ' & <', p_brand, '> '), p_size)"), F.lit("."))
    pages = part.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("title"), F.struct(text.alias("text")).alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "bzip2").save(path)
    found = predicates.wiki_pages(files.wiki_dump(spark, path))
    return found.select("title", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("""SELECT 'stackexchange:x:' || p_partkey AS source, sha256(t) AS text_sha256 FROM (
  SELECT *, '# ' || p_brand || chr(10) || chr(10) || 'Tags: a b ' || chr(10) || chr(10) || trim(repeat(p_name || ' & ', p_size)) AS t FROM part
) WHERE p_size % 3 <> 0 AND p_size % 6 >= 3 AND length(t) >= 120""")
def posts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as posts: attributes of rows, bodies escaped twice, a missing score where it would be zero."""
    path, part = folder(spark, "posts"), _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    body = F.concat(F.lit("<p>"), F.expr("repeat(concat(p_name, ' &amp; '), p_size)"), F.lit("</p>"))
    score = F.nullif((F.col("p_size") % 6).cast("string"), F.lit("0"))
    rows = part.select(
        F.col("p_partkey").cast("string").alias("_Id"), F.when(F.col("p_size") % 3 == 0, "2").otherwise("1").alias("_PostTypeId"), score.alias("_Score"),
        F.col("p_brand").alias("_Title"), body.alias("_Body"), F.lit("<a><b>").alias("_Tags"),
    )
    rows.write.format("xml").option("rootTag", "posts").option("rowTag", "row").save(path)
    made = predicates.question_posts(files.posts(spark, path), F.lit("x"))
    return made.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(f"""SELECT source, count(*) AS n_chunks FROM (
  SELECT source, {STRIP.format('substr(text, i * 1500 + 1, 1500)')} AS chunk FROM (
    SELECT source, text, unnest(generate_series(0, (length(text) - 1) // 1500)) AS i FROM (
      SELECT 'doc/' || doc_id AS source, text FROM documents UNION ALL SELECT 'user:' || page_id, html FROM pages)
    WHERE length({STRIP.format('text')}) >= 30)) WHERE chunk <> '' GROUP BY source""")
def two_phase_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then documents and project files, then both again: each source is in the table once."""
    path = folder(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"), "text", "lang")
    own = table(spark, sf_dir, "pages").select(F.concat(F.lit("user:"), F.col("page_id").cast("string")).alias("source"), F.col("html").alias("text"))
    for parts in ([docs.where("lang = 'en'")], [docs, own], [docs, own]):
        build.incremental_build(spark, path, parts)
    return files.table(spark, path, ["source"]).groupBy("source").agg(F.count("*").alias("n_chunks"))


@query("""SELECT n_name AS name, '# ' || n_name || chr(10) || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END || chr(10) AS text FROM nation""")
def articles_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of articles: those of the first run stay as they are in the second, and of equal titles the first page is taken."""
    path, nations = folder(spark, "articles"), table(spark, sf_dir, "nation")
    pages = lambda text, pos: nations.select("n_nationkey", F.col("n_name").alias("title"), F.lit(text).alias("text"), F.lit(pos).alias("pos"))
    sinks.articles(pages("first", 0).where("n_nationkey % 2 = 0"), path)
    sinks.articles(pages("third", 2).unionByName(pages("second", 1)), path)
    read = spark.read.schema("value string, name string").text(path, wholetext=True)
    return read.select("name", F.col("value").alias("text"))


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, true AS fewer_files FROM documents GROUP BY lang, source""")
def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of many small files, rewritten; its rows are the same."""
    path, docs = folder(spark, "table"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    sinks.replace(docs.repartition(16), f"{path}/many")
    many = spark.read.parquet(f"{path}/many")
    sinks.compacted(many, f"{path}/few")
    few = spark.read.parquet(f"{path}/few")
    fewer = len(few.inputFiles()) < len(many.inputFiles())
    return few.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.lit(fewer).alias("fewer_files"))


@query("""SELECT c_custkey::VARCHAR AS tenant_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 60 ELSE (c_custkey % 3)::INT END AS max_requests_per_min, c_custkey % 2 = 0 AS enabled FROM customer""")
def tenants_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tenants in the JSON file; a missing limit is the default."""
    path, c = folder(spark, "tenants"), table(spark, sf_dir, "customer")
    limit = F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 3).cast("int"))
    made = c.select(F.col("c_custkey").cast("string").alias("tenant_id"), F.col("c_name").alias("name"), limit.alias("max_requests_per_min"), (F.col("c_custkey") % 2 == 0).alias("enabled"))
    sinks.tenants_json(made, path)
    return files.tenants(spark, path).select("tenant_id", "name", "max_requests_per_min", "enabled")


@query("""SELECT tenant_id, count(*) AS n FROM (SELECT (user_id % 7)::VARCHAR AS tenant_id, user_id FROM events) WHERE tenant_id <> '3' GROUP BY tenant_id""")
def tenant_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks of tenants, one of whom has no room left; what fits is appended by tenant."""
    path = folder(spark, "by-tenant")
    chunks = table(spark, sf_dir, "events").select((F.col("user_id") % 7).cast("string").alias("tenant_id"), "event_id")
    tenants = chunks.select("tenant_id").distinct().withColumn("max_chunks", F.when(F.col("tenant_id") == "3", 1).otherwise(1_000_000_000))
    sinks.append_by_tenant(sinks.within_quota(chunks, chunks.limit(0), tenants), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("tenant_id").cast("string").alias("tenant_id")).agg(F.count("*").alias("n"))


@query("""SELECT 'en' || w AS wiki, 'https://dumps.wikimedia.org/en' || w || '/latest/en' || w || '-latest-pages-articles.xml.bz2' AS url, 'en' || w || '-articles.xml.bz2' AS file, n_docs
FROM (VALUES ('wikibooks'), ('wikiversity'), ('wikisource'), ('wiktionary')) t(w), (SELECT count(*) AS n_docs FROM documents WHERE lang = 'en' HAVING count(*) > 0)""")
def optional_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional dumps of the English documents' language, with the number of these."""
    langs = table(spark, sf_dir, "documents").where("lang = 'en'").groupBy("lang").agg(F.count("*").alias("n_docs"))
    return catalog.wiki_dumps(spark).join(langs, F.substring("wiki", 1, 2) == F.col("lang")).select("wiki", "url", "file", "n_docs")


@query("""SELECT 'rfcs/' || s AS path, 'rfcs' AS root, row_number() OVER (ORDER BY n DESC, s) AS place
FROM (SELECT source AS s, count(*) AS n FROM documents GROUP BY source)""")
def prioritised_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As prioritised_paths, with the root and the place by its priority, then by documents."""
    names = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    paths = names.select("n", F.explode(F.transform(F.array(F.lit("other/"), F.lit("books/"), F.lit("rfcs/")), lambda p: F.concat(p, F.col("source")))).alias("path"))
    kept = catalog.prioritised(paths.select("path"), spark).join(paths, "path")
    return kept.select("path", "root", F.row_number().over(W.orderBy("ord", F.desc("n"), "path")).alias("place"))


@query("""SELECT d.source AS path, length(d.source) AS n FROM (SELECT DISTINCT 'rfcs/' || source AS source FROM documents) d""")
def prioritised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sources below three folders, one is a source root, one is excluded and one is neither."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    paths = names.select(F.explode(F.transform(F.array(F.lit("rfcs/"), F.lit("books/"), F.lit("other/")), lambda p: F.concat(p, F.col("source")))).alias("path"))
    return catalog.prioritised(paths, spark).select("path", F.length("path").alias("n"))


@query("""SELECT page_id, url AS source FROM pages p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND d.lang = 'en')""")
def unseen_project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project files whose label the table does not hold; documents of one language stand for what it holds."""
    label = lambda c: F.concat(F.lit("user:"), c.cast("string"))
    own = table(spark, sf_dir, "pages").select("page_id", F.col("url"), label(F.col("page_id")).alias("source"))
    stored = table(spark, sf_dir, "documents").where("lang = 'en'").select(label(F.col("doc_id")).alias("source"))
    return joins.unseen(own, stored).select("page_id", F.col("url").alias("source"))


@query("""SELECT doc_id, coalesce(lang <> 'en', false) AS in_first, coalesce(lang <> 'de', false) AS in_last FROM documents""")
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in two parts, rebuilt without one language, extended, compacted: each version still has its rows."""
    path, docs = folder(spark, "versions"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    first = versions.append(docs.where("lang <> 'en'"), path)
    versions.append(docs.where("lang = 'en'"), path)
    versions.replace(versions.read(spark, path).where("lang NOT IN ('de', 'en')"), path)
    versions.append(docs.where("lang = 'en'"), path)
    last = versions.compact(spark, path)
    held = lambda n, name: versions.read(spark, path, n).select("doc_id", F.lit(True).alias(name))
    both = docs.join(held(first, "in_first"), "doc_id", "left").join(held(last, "in_last"), "doc_id", "left")
    return both.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_first", "in_last")))
