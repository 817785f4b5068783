"""Queries of the serving path: gates, tenants, caches, audits, prompts and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.functions import sources, text
from loamstone.operators import audit, domains, joins, predicates, prompts, ranking, stats
from loamstone.plans.registry import query, table
from loamstone.streaming import admission, cache

# Texts with something to find: odd documents get one of the samples before them.
SAMPLES = (
    "eval (x)", "os.system ('ls')", "password = 'abcd'", "verify = False", "BACKDOOR", "chmod 777 /x", "skip the auth",
    "yaml.load(f)", "innerHTML = y", "```py\nexec(a)\n``` and eval(b)",
)
SQL_SAMPLES = "['" + "', '".join(s.replace("'", "''").replace("\n", "' || chr(10) || '") for s in SAMPLES) + "']"
SQL_TEXT = f"CASE WHEN doc_id % 2 = 1 THEN ({SQL_SAMPLES})[(doc_id % {len(SAMPLES)}) + 1] || ' ' ELSE '' END || coalesce(text, '')"
_RULES_SQL = ", ".join("('" + name.replace("'", "''") + f"', '{severity}', '" + p.replace("'", "''") + "')" for p, name, severity in audit.RULES)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
    prefix = F.when(F.col("doc_id") % 2 == 1, F.concat(sample, F.lit(" "))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(prefix, F.coalesce("text", F.lit(""))).alias("text"))


@query(f"""SELECT rule, severity, sum(len(regexp_extract_all(t, p, 0, 'i')))::BIGINT AS n
FROM (SELECT {SQL_TEXT} AS t FROM documents), (VALUES {_RULES_SQL}) r(rule, severity, p) GROUP BY rule, severity""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).select(F.inline(audit.rule_counts(F.col("text"))))
    return rows.groupBy("rule", "severity").agg(F.sum("n").alias("n"))


@query()
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with surroundings, from fences or else the whole text."""
    found = audit.audited(_answers(spark, sf_dir))
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


_RULE_LIST = "[" + ", ".join("{'rule': '" + name.replace("'", "''") + "', 'p': '" + p.replace("'", "''") + "'}" for p, name, _ in audit.RULES) + "]"


@query(f"""WITH t AS (SELECT doc_id, {SQL_TEXT} AS t FROM documents), f AS (
  SELECT doc_id, t, array_to_string(regexp_extract_all(t, '(?s)```\\w*\\n(.*?)```', 1), chr(0)) AS fenced FROM t
), r AS (SELECT doc_id, t, fenced, unnest({_RULE_LIST}) AS r FROM f
), n AS (SELECT doc_id, r.rule AS rule, len(regexp_extract_all(t, r.p, 0, 'i')) AS n_all, len(regexp_extract_all(fenced, r.p, 0, 'i')) AS n_fenced FROM r
), w AS (SELECT *, sum(n_fenced) OVER (PARTITION BY doc_id) AS any_fenced FROM n)
SELECT doc_id, rule, (CASE WHEN any_fenced > 0 THEN n_fenced ELSE n_all END)::BIGINT AS n FROM w WHERE CASE WHEN any_fenced > 0 THEN n_fenced ELSE n_all END > 0""")
def audit_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each rule a document has, from its fences or else the whole text."""
    found = audit.audited(_answers(spark, sf_dir)).select("doc_id", F.explode("findings").alias("f"))
    return found.groupBy("doc_id", F.col("f.rule").alias("rule")).agg(F.count("*").alias("n"))


@query()
def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.audited(_answers(spark, sf_dir)).where("size(findings) > 0")
    return found.select("doc_id", F.size(audit.shown_findings(F.col("findings"))).alias("n_shown"), audit.report(F.col("findings")).alias("report"))


_FORBIDDEN_SQL = " OR ".join(f"contains(t, '{k}')" for k in predicates.FORBIDDEN)


@query(f"""SELECT conv_id, turn, NOT ({_FORBIDDEN_SQL}) AS safe FROM (
  SELECT conv_id, turn, lower(CASE conv_id % 5 WHEN 1 THEN 'Drop Table ' WHEN 2 THEN '/code keylogger ' ELSE '' END || text) AS t
  FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations) WHERE role = 'user')""")
def intent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate sees the raw question with its mode."""
    prefix = F.expr("CASE conv_id % 5 WHEN 1 THEN 'Drop Table ' WHEN 2 THEN '/code keylogger ' ELSE '' END")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").fillna({"text": ""})
    return asked.select("conv_id", "turn", predicates.safe_intent(F.concat(prefix, "text")).alias("safe"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 THEN 'review' ELSE 'support' END AS mode, sha256(text) AS question_sha256
FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations) WHERE role = 'user'""")
def mode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").fillna({"text": ""})
    raw = F.concat(F.expr("CASE conv_id % 3 WHEN 1 THEN '/review ' ELSE '' END"), "text")
    mode, question = text.mode_of(raw)
    return asked.select("conv_id", "turn", mode.alias("mode"), F.sha2(question.cast("binary"), 256).alias("question_sha256"))


_DETECTED = ("Please review my text: ", "Is there a CVE-1 in ", "Write a function for ", "")


@query(f"""SELECT conv_id, turn, CASE WHEN contains(q, 'security audit') OR contains(q, 'vulnerab') OR contains(q, 'cve-') THEN 'audit'
  WHEN contains(q, 'review this') OR contains(q, 'review my') OR contains(q, 'code review') THEN 'review'
  WHEN contains(q, '```') OR contains(q, 'write a function') OR contains(q, 'write a script') OR contains(q, 'implement ') THEN 'code' ELSE 'support' END AS mode
FROM (SELECT conv_id, turn, lower({list(_DETECTED)}[conv_id % 4 + 1] || coalesce(text, '')) AS q FROM conversations WHERE role = 'user')""")
def mode_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a mode of their own: it is detected."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").fillna({"text": ""})
    start = F.get(F.array(*[F.lit(x) for x in _DETECTED]), (F.col("conv_id") % 4).cast("int"))
    return asked.select("conv_id", "turn", text.mode_of(F.concat(start, F.col("text")), detect=True)[0].alias("mode"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN trim(q) WHEN starts_with(lower(trim(q)), 'inform') OR starts_with(lower(trim(q)), 'law')
  THEN trim(q) ELSE 'Informatics Law: ' || trim(q) END AS enhanced
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN 'informatics ' ELSE '' END || coalesce(text, '') AS q FROM conversations WHERE role = 'user')""")
def enhance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation is in universal mode, which leaves questions as they are."""
    names = F.array(F.lit("Informatics"), F.lit("Law"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").fillna({"text": ""})
    raw = F.concat(F.expr("CASE conv_id % 4 WHEN 1 THEN 'informatics ' ELSE '' END"), "text")
    ids = F.array(F.lit("it"), F.when(F.col("conv_id") % 3 == 0, "universal").otherwise("law"))
    universal = domains.is_universal(ids)
    return asked.select("conv_id", "turn", domains.enhanced(raw, names, universal).alias("enhanced"))


@query("""SELECT user_id::VARCHAR AS tenant_id, count(*) AS n_requests,
  count(*) FILTER (WHERE ts <= (SELECT max(ts) FROM events) AND ts > (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND) AS n_recent FROM events GROUP BY user_id""")
def tenant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by tenant, and those of the day before the last event."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    requests = events.select(F.col("user_id").cast("string").alias("tenant_id"), "ts")
    return stats.tenant_stats(requests, F.lit(now), 86400)


@query("""SELECT user_id::VARCHAR AS tenant_id, substr(key, 1, 8) AS hash_start, 'it_prime_' || CASE WHEN user_id % 2 = 0 THEN 's' || user_id ELSE user_id::VARCHAR END AS table_name, n
FROM (SELECT user_id, sha256('key' || user_id) AS key, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY user_id)""")
def api_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests resolved to tenants by key; every third tenant is disabled."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("tenant_id"), "user_id").distinct()
    tenants = users.select(
        "tenant_id", F.sha2(F.concat(F.lit("key"), "tenant_id"), 256).alias("api_key_hash"), (F.col("user_id") % 3 != 0).alias("enabled"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("s"), "tenant_id")).otherwise("").alias("table_suffix"),
    )
    key = F.concat(F.lit("key"), F.col("user_id").cast("string"))
    headers = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("x-api-key"), key)).otherwise(
        F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), key))
    )
    requests = table(spark, sf_dir, "events").select("event_id", headers.alias("headers"))
    found = joins.tenants_of_keys(requests, tenants).where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.count("*").alias("n"))
    named = found.join(tenants, "tenant_id")
    return named.select(
        "tenant_id", F.substring("api_key_hash", 1, 8).alias("hash_start"),
        sources.table_name("it_prime", F.col("tenant_id"), F.col("table_suffix")).alias("table_name"), "n",
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; hours count as seconds, so that limits bind."""
    micros = F.expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("tenant_id"),
        micros.alias("ts"), F.lit("start").alias("kind"),
    )


SQL_REQUESTS = """r AS (SELECT event_id, user_id, event_id % 4 = 3 AS is_end, epoch_us(ts) // 3600 AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600, event_id) AS n FROM events)"""


@query(f"""WITH RECURSIVE {SQL_REQUESTS}, run AS (
  SELECT user_id, n, event_id, [t] AS recent, true AS admitted FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.n, r.event_id, CASE WHEN len(recent) < 3 OR r.t - recent[-3] >= 60000000 THEN list_append(recent, r.t) ELSE recent END,
         len(recent) < 3 OR r.t - recent[-3] >= 60000000
  FROM run JOIN r ON r.user_id = run.user_id AND r.n = run.n + 1
) SELECT event_id AS request_id, user_id::VARCHAR AS tenant_id, admitted FROM run""")
def rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of every request in time order; what is rejected leaves no trace, which SQL windows cannot say but a recursion can."""
    requests = _requests(spark, sf_dir)
    tenants = requests.select("tenant_id").distinct().withColumns(
        {"max_requests_per_min": F.lit(3), "max_concurrent": F.lit(1_000_000)}
    )
    return admission.admit(requests, tenants).select("request_id", "tenant_id", "admitted")


@query(f"""WITH RECURSIVE {SQL_REQUESTS}, run AS (
  SELECT user_id, n, event_id, is_end, CASE WHEN is_end OR user_id % 5 = 0 THEN 0 ELSE 1 END AS running, user_id % 5 <> 0 AS admitted FROM r WHERE n = 1
  UNION ALL
  SELECT r.user_id, r.n, r.event_id, r.is_end, CASE WHEN r.is_end THEN greatest(running - 1, 0) WHEN running < 2 AND r.user_id % 5 <> 0 THEN running + 1 ELSE running END,
         running < 2 AND r.user_id % 5 <> 0
  FROM run JOIN r ON r.user_id = run.user_id AND r.n = run.n + 1
) SELECT event_id AS request_id, user_id::VARCHAR AS tenant_id, CASE WHEN NOT is_end THEN admitted END AS admitted FROM run""")
def release_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on running requests: every fourth event ends one, below none there is nothing to end; every fifth tenant is unknown."""
    requests = _requests(spark, sf_dir).withColumn("kind", F.when(F.col("request_id") % 4 == 3, "end").otherwise("start"))
    tenants = requests.where("CAST(tenant_id AS LONG) % 5 <> 0").select("tenant_id").distinct().withColumns(
        {"max_requests_per_min": F.lit(1_000_000), "max_concurrent": F.lit(2)}
    )
    return admission.admit(requests, tenants).select("request_id", "tenant_id", "admitted")


@query("""WITH o AS (SELECT event_id AS seq, user_id, event_type AS q, epoch_us(ts) / 1e6 AS t,
    CASE WHEN event_id % 50 = 7 THEN 'drop' WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS op FROM events
), s AS (
  SELECT *, count(*) FILTER (WHERE op = 'drop') OVER w AS era, max(CASE WHEN op = 'put' THEN seq END) OVER (PARTITION BY user_id, q ORDER BY seq) AS put_seq FROM o
  WINDOW w AS (PARTITION BY user_id ORDER BY seq)
) SELECT s.seq, s.op, CASE WHEN s.op <> 'get' THEN NULL WHEN p.seq IS NOT NULL AND p.era = s.era AND s.t - p.t <= 864000 THEN 'l1' ELSE 'miss' END AS outcome,
  CASE WHEN s.op = 'get' AND p.seq IS NOT NULL AND p.era = s.era AND s.t - p.t <= 864000 THEN p.seq::VARCHAR END AS result
FROM s LEFT JOIN s p ON p.seq = s.put_seq AND p.op = 'put'""")
def cache_exact_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of events replayed against caches, one a user: stores, lookups without vectors and wipes; ten days to live."""
    e, seq = table(spark, sf_dir, "events"), F.col("event_id")
    op = F.when(seq % 50 == 7, "drop").when(seq % 3 == 0, "put").otherwise("get")
    log = e.select(
        seq.alias("seq"), F.col("user_id").cast("string").alias("cache"), op.alias("op"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.when(op != "drop", F.col("event_type")).alias("query"), F.lit(None).cast("array<double>").alias("vector"), seq.cast("string").alias("result"),
    )
    return cache.replay(log, cache.Profile(500, 10 * 86400.0, 0.95)).select("seq", "op", "outcome", "result")


@query()
def cache_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of lookups and stores replayed against the cache."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    seq = F.col("vec_id")
    log = e.select(
        seq.alias("seq"), (seq % 4).cast("string").alias("cache"), F.when(seq % 3 == 0, "put").otherwise("get").alias("op"),
        seq.cast("double").alias("ts"), F.concat(F.lit("q"), (seq % 40).cast("string")).alias("query"), "vector", seq.cast("string").alias("result"),
    )
    return cache.replay(log, cache.Profile(8, 120.0, 0.4))


@query("""SELECT (SELECT count(*) FROM events WHERE event_type = 'click') AS l1_hits, (SELECT count(*) FROM events WHERE event_type = 'view') AS l2_hits,
  (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) AS total_hits, (SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view')) AS total_misses,
  round((SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) / (SELECT count(*) FROM events)::DOUBLE, 9) AS hit_rate""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by kind of event."""
    kind = F.when(F.col("event_type") == "click", "l1").when(F.col("event_type") == "view", "l2").otherwise("miss")
    made = stats.cache_stats(table(spark, sf_dir, "events").select(kind.alias("outcome")))
    return made.withColumn("hit_rate", F.round("hit_rate", 9))


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 500""")
def lru_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("last_access"), F.col("event_id").alias("seq"))
    return ranking.most_recent(entries, 500).select("event_id", "user_id")


@query("""SELECT count(*) FILTER (WHERE (SELECT max(ts) FROM events) - ts <= INTERVAL 10 DAY) AS live,
  count(*) FILTER (WHERE (SELECT max(ts) FROM events) - ts > INTERVAL 10 DAY) AS expired FROM events""")
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age counts from creation, and an entry of exactly the limit is alive."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    old = cache.expired(F.col("ts"), F.lit(now), 10 * 86400)
    return events.agg(F.count_if(~old).alias("live"), F.count_if(old).alias("expired"))


@query("""SELECT p_partkey, v, v2, [x::INT FOR x IN string_split(v, '.')[1:3]] > [x::INT FOR x IN string_split(v2, '.')[1:3]] AS newer FROM (
  SELECT p_partkey, '1.' || p_size || '.' || (p_partkey % 12) AS v, CASE WHEN p_partkey % 2 = 0 THEN '1.9.0' ELSE '1.10' END AS v2 FROM part)""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    v = F.format_string("1.%d.%d", "p_size", F.col("p_partkey") % 12)
    v2 = F.when(F.col("p_partkey") % 2 == 0, "1.9.0").otherwise("1.10")
    made = part.select("p_partkey", v.alias("v"), v2.alias("v2"))
    return made.withColumn("newer", text.version_key(F.col("v")) > text.version_key(F.col("v2")))


@query("""SELECT coalesce(max('pack-' || p_size || '.zip'), 'pack.zip') AS filename FROM part""")
def latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.format_string("pack-%d.zip", "p_size").alias("filename"))
    return ranking.latest_release(files, "pack.zip")


@query("""SELECT name AS model FROM (SELECT lower(p_name) AS n, p_name AS name, p_partkey FROM part)
  ORDER BY CASE WHEN contains(n, 'no such') THEN 0 WHEN contains(n, '1') THEN 1 WHEN contains(n, '2') THEN 2 ELSE 3 END, p_partkey LIMIT 1""")
def model_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return joins.preferred_model(available, ("no such", "1", "2"))


@query("""SELECT p_partkey, CASE WHEN contains(m, '32b') OR contains(m, '70b') THEN 2048 WHEN contains(m, '14b') THEN 3072
    WHEN contains(m, '7b') OR contains(m, '8b') THEN 4096 ELSE 8192 END AS context,
  CASE WHEN f < 2000 THEN greatest(25, b // 8) WHEN f < 4000 THEN greatest(50, b // 4) WHEN f < 8000 THEN greatest(100, b // 2) ELSE b END AS batch
FROM (SELECT p_partkey, 'model-' || p_size || 'B' AS m, p_size AS f0, (p_partkey % 10) * 1000 AS f, (p_partkey % 600)::INT AS b FROM part)
""".replace("contains(m,", "contains(lower(m),"))
def model_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context windows by model name and batch sizes by free memory."""
    made = table(spark, sf_dir, "part").select(
        "p_partkey", F.format_string("model-%dB", "p_size").alias("m"), (F.col("p_partkey") % 10 * 1000).alias("f"),
        (F.col("p_partkey") % 600).cast("int").alias("b"),
    )
    return made.select("p_partkey", prompts.context_window(F.col("m")).alias("context"), prompts.batch_size(F.col("f"), F.col("b")).alias("batch"))


_SYSTEM_SQL = "CASE conv_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(prompts.SYSTEM.values())) + " END"


@query(f"""SELECT conv_id, turn, 'system,user' AS roles, sha256({_SYSTEM_SQL} || chr(10) || 'Context:' || chr(10) || '[1] ' || source || chr(10) || chr(10) || chr(10) || 'Sources:' || chr(10)
  || array_to_string([source || '#' || i FOR i IN generate_series(1, least(10, conv_id % 14))], chr(10)) || chr(10) || chr(10) || 'Question: ' || text) AS sha256
FROM (SELECT conv_id, turn, coalesce(text, '') AS text, 'src' || turn AS source FROM conversations WHERE role = 'user')""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes, contexts, and from none to more sources than are cited; the digest is of the whole messages."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").fillna({"text": ""})
    mode = F.element_at(F.array(*[F.lit(m) for m in prompts.SYSTEM]), (F.col("conv_id") % 4 + 1).cast("int"))
    source = F.concat(F.lit("src"), F.col("turn").cast("string"))
    numbers = F.filter(F.sequence(F.lit(0).cast("long"), F.col("conv_id") % 14), lambda i: i > 0)
    cited = F.transform(numbers, lambda i: F.concat(source, F.lit("#"), i.cast("string")))
    messages = prompts.chat_messages(mode, F.col("text"), F.concat(F.lit("[1] "), source, F.lit("\n")), cited)
    made = asked.select("conv_id", "turn", messages.alias("m"))
    whole = F.array_join(F.transform("m", lambda x: x["content"]), "\n")
    return made.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.sha2(whole.cast("binary"), 256).alias("sha256"))


@query("""SELECT bool_and(n > 0) AS ok FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM embeddings UNION ALL SELECT count(*) FROM pages)""")
def system_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = None
    for name in ("documents", "embeddings", "pages"):
        one = table(spark, sf_dir, name).agg((F.count("*") > 0).alias("ok"))
        checks = one if checks is None else checks.unionByName(one)
    return stats.all_ok(checks)


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS part, count(*) AS whole,
  round(count(*) FILTER (WHERE l_discount > 0.05) / count(*)::DOUBLE, 9) AS rate FROM lineitem GROUP BY l_returnflag""")
def guarded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that are 0 where nothing was counted; lineitem stands for a log."""
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("part"), F.count("*").alias("whole")
    )
    return made.withColumn("rate", F.round(text.guarded_rate(F.col("part"), F.col("whole")), 9))


@query("""SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source""")
def distinct_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by source as the keys of a map, though some are listed twice."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("t"))
    made = docs.select("source", domains.distinct_map(F.concat("t", "t"), F.lit(0)).alias("m"))
    return made.select("source", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("langs"))


@query("""SELECT doc_id, contains(s, '/projects/') OR starts_with(s, 'user:') AS user_project FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'user:' WHEN 1 THEN 'a/projects/' ELSE '' END || source AS s FROM documents)""")
def user_project_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN 'user:' WHEN 1 THEN 'a\\\\projects\\\\' ELSE '' END"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", sources.is_user_project(label).alias("user_project"))


@query("""SELECT lang, array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source NOT LIKE 'src1%')), ',') AS kept FROM documents GROUP BY lang""")
def pruned_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished topics without those to be read again; src1... is named like one of these."""
    topic = F.when(F.col("source").startswith("src1"), F.concat(F.lit("Daten"), "source")).otherwise(F.col("source"))
    done = table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set(topic).alias("done"))
    return done.select("lang", F.array_join(F.sort_array(predicates.pruned_queue(F.col("done"))), ",").alias("kept"))
