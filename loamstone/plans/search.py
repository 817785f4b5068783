"""Queries of the search path: nearest vectors, reranking, context, full text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions import sources, vectors
from loamstone.operators import cells, embed, fts, joins, predicates, ranking, segments, stats
from loamstone.plans.registry import ORACLES, folder, query, table
from loamstone.streaming.cache import PROFILES

#: Stand-ins for domain dimensions that suit the fixtures' source labels.
BLOCKED = ("src7", "lab3")
BOOSTS = (("src1", 1.2), ("src12", 1.5), ("lab2", 1.3), ("src2", 0.8), ("lab5", 0.7))

SQL_BOOST = """CASE WHEN contains(s, 'src7') OR contains(s, 'lab3') THEN 0.0 WHEN contains(s, 'src1') THEN 1.2
  WHEN contains(s, 'src12') THEN 1.5 WHEN contains(s, 'lab2') THEN 1.3 WHEN contains(s, 'src2') THEN 0.8
  WHEN contains(s, 'lab5') THEN 0.7 ELSE 0.95 END"""
SQL_DISTANCE = "list_sum(list_transform(list_zip(e.embedding, q.v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))"
SQL_Q = "(SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q"


def _question(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of one row, which stands for an embedded question."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"]) if row else [0.0]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("lab"), F.col("label").cast("string")).alias("source"))


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Nearest vectors with the text of the document of the same number, in order."""
    near = ranking.top_k(_chunks(spark, sf_dir).withColumnRenamed("vec_id", "id"), _question(spark, sf_dir), k)
    near = near.select("id", "source", "_distance")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rank = F.row_number().over(W.orderBy("_distance", "id"))
    return near.join(docs, "id", "left").withColumn("in_rank", rank)


@query(f"""SELECT vec_id, round({SQL_DISTANCE}, 9) AS distance FROM embeddings e, {SQL_Q} ORDER BY {SQL_DISTANCE}, vec_id LIMIT 32""")
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ranking.top_k(_chunks(spark, sf_dir), _question(spark, sf_dir), key="vec_id")
    return near.select("vec_id", F.round("_distance", 9).alias("distance"))


@query(f"""SELECT qid, vec_id, rank, round(d, 9) AS distance FROM (
  SELECT q.vec_id AS qid, e.vec_id, {SQL_DISTANCE.replace('q.v)', 'q.embedding)')} AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {SQL_DISTANCE.replace('q.v)', 'q.embedding)')}, e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0) WHERE rank <= 5""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of questions (every hundredth vector) against all chunks."""
    e = table(spark, sf_dir, "embeddings")
    questions = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    near = ranking.top_k_join(questions, _chunks(spark, sf_dir), 5, key="vec_id")
    return near.select("qid", "vec_id", F.col("rank").cast("long"), F.round("_distance", 9).alias("distance"))


@query(f"""SELECT count(*) AS n FROM (SELECT {SQL_DISTANCE} AS d FROM embeddings e, {SQL_Q}) WHERE d <= 1.35""")
def distance_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _question(spark, sf_dir)])
    near = _chunks(spark, sf_dir).select(vectors.squared_l2(F.col("vector"), q).alias("d"))
    return near.where(predicates.within_distance(F.col("d"))).agg(F.count("*").alias("n"))


@query(f"""WITH near AS (
  SELECT e.vec_id AS id, 'lab' || label AS s, {SQL_DISTANCE} AS d FROM embeddings e, {SQL_Q} ORDER BY d, id LIMIT 32
), hits AS (
  SELECT n.id, s, d, text, row_number() OVER (ORDER BY d, n.id) AS in_rank FROM near n LEFT JOIN documents ON doc_id = n.id
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY left(trim(text), 200) ORDER BY in_rank) AS rn FROM hits
  WHERE length(trim(coalesce(text, ''))) >= 25 AND NOT contains(s, 'lab3')
)
SELECT id, round(1 / (1 + d) * {SQL_BOOST}, 9) AS score, row_number() OVER (ORDER BY 1 / (1 + d) * {SQL_BOOST} DESC, in_rank) AS out_rank
FROM kept WHERE rn = 1 ORDER BY out_rank LIMIT 8""")
def relevance_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors, their relevance, and the rerank with its filters and prefix dedup."""
    s = F.col("source")
    best = ranking.rerank(_hits(spark, sf_dir, 32), sources.boost(s, BOOSTS, BLOCKED), sources.is_blocked(s, BLOCKED), 8)
    return best.select("id", F.round("score", 9).alias("score"), F.col("out_rank").cast("long"))


@query("""WITH pairs AS (
  SELECT a.vec_id AS qid, b.vec_id AS entry, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 1000) b
), best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, entry) AS rn FROM pairs)
SELECT qid, entry, round(s, 9) AS similarity FROM best WHERE rn = 1 AND s >= 0.3""")
def cosine_cache_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against a full cache of the search profile, which holds the entries stored last."""
    e = table(spark, sf_dir, "embeddings")
    questions = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    entries = e.select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vector"), F.col("vec_id").alias("last_access"), F.col("vec_id").alias("seq"))
    kept = ranking.most_recent(entries, PROFILES["search"].max_entries)
    return joins.nearest_cached(questions, kept, 0.3).select("qid", "entry", F.round("similarity", 9).alias("similarity"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 9) AS norm FROM embeddings""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 9).alias("norm"))


@query(f"""SELECT vec_id, round({SQL_DISTANCE}, 9) AS distance FROM embeddings e, {SQL_Q} ORDER BY {SQL_DISTANCE}, vec_id LIMIT 20""")
def binary_quantised_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question: sign bits leave out only what they prove to be too far, so no neighbour is lost."""
    one = spark.createDataFrame([(0, _question(spark, sf_dir))], "qid long, vector array<float>")
    near = ranking.top_k_join(one, _chunks(spark, sf_dir), 20, key="vec_id", quantised=True)
    return near.select("vec_id", F.round("_distance", 9).alias("distance"))


@query(f"""SELECT qid, vec_id, rank, round(d, 9) AS distance FROM (
  SELECT q.vec_id AS qid, e.vec_id, {SQL_DISTANCE.replace('q.v)', 'q.embedding)')} AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {SQL_DISTANCE.replace('q.v)', 'q.embedding)')}, e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0) WHERE rank <= 20""")
def binary_quantised_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all chunks: sign bits leave out only what they prove to be too far."""
    e = table(spark, sf_dir, "embeddings")
    questions = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    near = ranking.top_k_join(questions, _chunks(spark, sf_dir), 20, key="vec_id", quantised=True)
    return near.select("qid", "vec_id", F.col("rank").cast("long"), F.round("_distance", 9).alias("distance"))


@query("""WITH b AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, source, trim(coalesce(text, '')) AS t FROM documents
), blocks AS (
  SELECT doc_id, n, source, '[' || n || '] ' || source || chr(10) || t || chr(10) AS block FROM b
), s AS (SELECT *, sum(length(block)) OVER (ORDER BY n) AS total FROM blocks)
SELECT doc_id, n, total::BIGINT AS total, sha256(block) AS block_sha256 FROM s WHERE total <= 14000""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as if ranked by id; candidates are cut to the budget's reach before the running sum."""
    hits = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("doc_id").alias("rank"))
    most = ranking.MAX_CONTEXT_CHARS // 5  # a block has at least five characters
    blocks = ranking.context_blocks(hits.orderBy("rank").limit(most))
    return blocks.select(
        "doc_id", F.col("n").cast("long"), F.col("total").cast("long"), F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256")
    )


@query("""WITH b AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, trim(coalesce(text, '')) AS t FROM documents
), blocks AS (SELECT *, '[' || n || '] ' || source || chr(10) || t || chr(10) AS block FROM b
), s AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY n) AS total FROM blocks)
SELECT source, count(*) AS n_blocks, sha256(string_agg(block, chr(10) ORDER BY n)) AS context_sha256 FROM s WHERE total <= 14000 GROUP BY source""")
def context_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context for each source, as for a batch of questions."""
    hits = table(spark, sf_dir, "documents").select("text", "source", F.col("doc_id").alias("rank"))
    made = ranking.context(ranking.context_blocks(hits.withColumn("g", F.col("source")), group=["g"]), group=["g"])
    return made.select(
        F.col("g").alias("source"), F.size("sources").cast("long").alias("n_blocks"),
        F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"),
    )


SQL_BM25 = """WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents
), stats AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t
), p AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t
), tf AS (SELECT term, doc_id, l, count(*) AS tf FROM p WHERE term IN ('the', 'of', 'der', 'que', 'scum') GROUP BY ALL
), q(qid, term) AS (VALUES (1, 'the'), (1, 'of'), (2, 'der'), (2, 'scum'), (3, 'que')
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), s AS (
  SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY qid, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""
QUESTIONS = [(1, "the"), (1, "of"), (2, "der"), (2, "scum"), (3, "que")]


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    questions = spark.createDataFrame(QUESTIONS, "qid int, term string")
    return fts.bm25(fts.postings(docs, only=questions), fts.doc_stats(docs), questions, 10)


@query(SQL_BM25)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(SQL_BM25.rsplit("SELECT", 1)[0].rstrip() + """, v AS (
  SELECT e.vec_id AS doc_id, row_number() OVER (ORDER BY """ + SQL_DISTANCE + """, e.vec_id) AS rank FROM embeddings e, """ + SQL_Q + """
), ranked AS (
  SELECT doc_id, rank FROM r WHERE qid = 1 AND rank <= 10 UNION ALL SELECT doc_id, rank FROM v WHERE rank <= 10
), f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text and vector ranks of one question, fused."""
    text = _bm25(spark, sf_dir).where("qid = 1")
    one = spark.createDataFrame([(1, _question(spark, sf_dir))], "qid int, vector array<float>")
    near = ranking.top_k_join(one, _chunks(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), 10, key="doc_id")
    return fts.fused(text, near, 10).select("doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH h AS (SELECT d.doc_id, source AS s, row_number() OVER (ORDER BY doc_id) AS rank FROM documents d),
b AS (SELECT doc_id, CASE WHEN s LIKE '%src3%' THEN 'user' ELSE 'general' END AS branch, rank FROM h)
SELECT doc_id, branch, br AS branch_rank FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY rank) AS br FROM b)
WHERE br <= CASE WHEN branch = 'user' THEN 4 ELSE 8 END""")
def two_branch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("rank"))
    best = ranking.two_branch(hits, F.col("source").contains("src3"))
    return best.select("doc_id", "branch", F.col("branch_rank").cast("long"))


@query(f"""WITH h AS (SELECT q.label AS qid, e.vec_id, 'x/lab' || e.label AS s, {SQL_DISTANCE} AS d FROM embeddings e, {SQL_Q}, (SELECT DISTINCT label FROM embeddings) q
  WHERE e.label = q.label), r AS (SELECT *, 1 / (1 + d) * {SQL_BOOST} AS score FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d) AS rn FROM r)
SELECT qid, round(score, 9) AS score, round(d, 9) AS distance, left(split_part(s, '/', 2), 48) AS label FROM o WHERE rn = 1""")
def hit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each label, summarised."""
    q = F.array(*[F.lit(float(x)) for x in _question(spark, sf_dir)])
    e = table(spark, sf_dir, "embeddings")
    hits = e.select(
        F.col("label").alias("qid"), F.concat(F.lit("x/lab"), F.col("label").cast("string")).alias("source"),
        vectors.squared_l2(F.col("embedding"), q).alias("_distance"),
    )
    best = stats.hit_summary(hits, sources.boost(F.col("source"), BOOSTS, BLOCKED))
    return best.select("qid", F.round("score", 9).alias("score"), F.round("distance", 9).alias("distance"), "label")


@query(SQL_BM25)
def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that was built and stored."""
    path = folder(spark, "index")
    fts.build_index(table(spark, sf_dir, "documents"), path)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    found = fts.bm25(read("postings"), read("docstats"), spark.createDataFrame(QUESTIONS, "qid int, term string"), 10)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(SQL_BM25)
def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of segments: documents are appended by language, levels merged, and ranges skipped that cannot matter."""
    path, docs = folder(spark, "segments"), table(spark, sf_dir, "documents")
    for part in ("lang = 'en'", "lang = 'de'", "lang = 'fr'", "lang NOT IN ('en', 'de', 'fr') OR lang IS NULL"):
        segments.append(docs.where(part), f"{path}/index")
    segments.merge_levels(spark, f"{path}/index")
    found, _ = segments.search(spark, f"{path}/index", spark.createDataFrame(QUESTIONS, "qid int, term string"), 10, f"{path}/scratch")
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("""WITH m AS (SELECT d.doc_id, min(o.doc_id) AS first FROM documents d JOIN documents o
  ON coalesce(d.text, '') = coalesce(o.text, '') GROUP BY d.doc_id)
SELECT doc_id AS qid, first = doc_id AS is_first, 0.0::DOUBLE AS distance FROM m WHERE doc_id % 100 = 0 AND EXISTS (
  SELECT 1 FROM documents x WHERE x.doc_id = m.doc_id AND length(trim(coalesce(x.text, ''))) > 0)""")
def asked_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every hundredth document as questions, embedded in micro-batches and asked of all embedded documents: each finds a text
    of its own vector, the first one among equal texts unless another text has the same vector."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("text", F.lit("")).alias("t"))
    load = lambda: embed.hashing_model(64)
    chunks = embed.embedded(docs, load).select(F.col("doc_id").alias("id"), "vector", "t")
    asked = embed.embed_queries(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("t").alias("query")), load, names=F.array(), universal=F.lit(True))
    near = ranking.top_k_join(asked, chunks, 1).where(F.col("_distance") < 1e-9)
    text = docs.select(F.col("doc_id").alias("id"), "t")
    first = text.groupBy("t").agg(F.min("id").alias("first")).join(text, "t").select("id", "first")
    return near.join(first.withColumnRenamed("id", "qid"), "qid").select("qid", (F.col("first") == F.col("qid")).alias("is_first"), F.round("_distance", 6).alias("distance"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events), pairs AS (
  SELECT q.event_id AS qid, max((p.t, p.event_id::VARCHAR)) AS e, any_value(q.t) AS t FROM e q JOIN e p
  ON q.event_type = p.event_type AND q.user_id = p.user_id AND q.event_id % 3 <> 0 AND p.event_id % 3 = 0 AND p.t <= q.t GROUP BY q.event_id)
SELECT qid, e[2] AS result FROM pairs WHERE t - e[1] <= 5 * 86400000000""")
def exact_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event stores its id under its user and type; the others look that up, and live five days."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("query"), F.col("ts").cast("timestamp").alias("ts"))
    stored = e.where("event_id % 3 = 0").select("query", F.col("event_id").cast("string").alias("result"), F.col("ts").alias("created"))
    return joins.exact_cached(e.where("event_id % 3 <> 0").select(F.col("event_id").alias("qid"), "query", "ts"), stored, 5 * 86400)


@query(f"""SELECT label, count(*) AS n FROM embeddings e, {SQL_Q} WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]) >= 0.42 GROUP BY label""")
def similar_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of each label are similar enough to the question."""
    q = F.array(*[F.lit(float(x)) for x in _question(spark, sf_dir)])
    near = table(spark, sf_dir, "embeddings").where(predicates.similar_enough(vectors.cosine(F.col("embedding"), q)))
    return near.groupBy("label").agg(F.count("*").alias("n"))


@query(ORACLES["vector_topk_batch"])
def vector_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vector_topk_batch, from a stored index of cells: the questions visit the cells that may hold a neighbour."""
    path, e = folder(spark, "cells"), table(spark, sf_dir, "embeddings")
    cells.build(_chunks(spark, sf_dir), f"{path}/index", key="vec_id")
    questions = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    near = cells.search(questions, f"{path}/index", 5, f"{path}/scratch", key="vec_id")
    return near.select("qid", "vec_id", F.col("rank").cast("long"), F.round("_distance", 9).alias("distance"))


@query("""WITH pairs AS (
  SELECT a.vec_id AS qid, b.vec_id AS entry, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON b.label < 5
), best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, entry) AS rn FROM pairs)
SELECT qid, entry, round(s, 9) AS similarity FROM best WHERE rn = 1 AND s >= 0.3""")
def cosine_cache_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against a stored cache of any size, the vectors of five labels, in cells."""
    path, e = folder(spark, "cache-cells"), table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    cells.build(cells.unit(e.where("label < 5").select(F.col("vec_id").alias("entry"), "vector")), f"{path}/index", key="entry")
    found = cells.nearest_stored(e.select(F.col("vec_id").alias("qid"), "vector"), f"{path}/index", 0.3, f"{path}/scratch")
    return found.select("qid", "entry", F.round("similarity", 9).alias("similarity"))


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events),
p AS (SELECT event_type, t, max(event_id::VARCHAR) AS result FROM e WHERE event_id % 3 = 0 GROUP BY event_type, t)
SELECT q.event_id AS qid, p.result FROM e q ASOF JOIN p ON q.event_type = p.event_type AND q.t >= p.t WHERE q.event_id % 3 <> 0 AND q.t - p.t <= 3600000000""")
def exact_cache_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As exact_cache_lookup, with five questions that all users ask and store again and again; entries live an hour."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("query"), F.col("ts").cast("timestamp").alias("ts"))
    stored = e.where("event_id % 3 = 0").select("query", F.col("event_id").cast("string").alias("result"), F.col("ts").alias("created"))
    return joins.exact_cached(e.where("event_id % 3 <> 0").select(F.col("event_id").alias("qid"), "query", "ts"), stored, 3600)
