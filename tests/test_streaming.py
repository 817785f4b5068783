"""Stateful operators against plain loops, in batch form and as streams."""

import random

from pyspark.sql import functions as F

from loamstone.streaming import admission, cache, ingest


def requests(n=400, seed=1):
    r, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.choice([0.0, 0.5, 1.0, 20.0, 60.0])
        out.append((i, f"t{r.randint(0, 2)}", t, "end" if r.random() < 0.3 else "start"))
    return out


def plain(rows, per_minute, concurrent):
    times, active, out = {}, {}, {}
    for i, tenant, now, kind in rows:
        if kind == "end":
            active[tenant] = max(0, active.get(tenant, 0) - 1)
            continue
        times[tenant] = [t for t in times.get(tenant, []) if now - t < 60]
        ok = len(times[tenant]) < per_minute and active.get(tenant, 0) < concurrent
        if ok:
            times[tenant].append(now)
            active[tenant] = active.get(tenant, 0) + 1
        out[i] = ok
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id long, tenant_id string, s double, kind string").select(
        "request_id", "tenant_id", F.timestamp_seconds("s").alias("ts"), "kind"
    )


def test_admission(spark):
    rows = requests() + [(900, "unknown", 5.0, "start")]
    tenants = spark.createDataFrame([(f"t{i}", 4, 3) for i in range(3)], "tenant_id string, max_requests_per_min int, max_concurrent int")
    got = {r.request_id: r.admitted for r in admission.admit(frame(spark, rows), tenants).where("kind = 'start'").collect()}
    assert got == {**plain(requests(), 4, 3), 900: False}


def test_admission_stream(spark, tmp_path):
    rows = requests()
    for k in range(4):
        frame(spark, rows[k * 100 : k * 100 + 100]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = admission.admit_stream(source, 4, 3).writeStream.format("memory").queryName("admitted").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert {r.request_id: r.admitted for r in spark.table("admitted").where("kind = 'start'").collect()} == plain(rows, 4, 3)


UNIT = {"a": [1.0, 0.0], "near a": [1.0, 0.1], "b": [0.0, 1.0], "zero": [0.0, 0.0]}
LOG = [
    ("get", 0.0, "a", "a", None), ("put", 1.0, "a", "a", "A"), ("get", 2.0, "a", "b", None), ("get", 3.0, "other", "near a", None),
    ("get", 4.0, "zero", "zero", None), ("get", 5.0, "none", None, None), ("put", 6.0, "b", "b", "B"), ("get", 7.0, "a", "a", None),
    ("put", 8.0, "c", "b", "C"), ("get", 9.0, "b", "a", None), ("get", 9.5, "c", None, None), ("put", 10.0, "a", "a", "A2"), ("get", 20.0, "a", "a", None),
    ("get", 20.5, "x", "a", None), ("invalidate", 21.0, None, None, None), ("get", 22.0, "a", "a", None),
]
WANT = ["miss", None, "l1", "l2", "miss", "miss", None, "l1", None, "l2", "l1", None, "l1", "miss", None, "miss"]


def log(spark):
    rows = [(i, "main", op, ts, q, UNIT.get(v), result) for i, (op, ts, q, v, result) in enumerate(LOG)]
    return spark.createDataFrame(rows, "seq long, cache string, op string, ts double, query string, vector array<double>, result string")


def test_cache(spark):
    got = cache.replay(log(spark), cache.Profile(2, 10.0, 0.95)).orderBy("seq").collect()
    assert [r.outcome for r in got] == WANT
    assert got[9].result == "A" and got[12].result == "A2" and max(r.entries for r in got) == 2


def test_cache_stream(spark, tmp_path):
    for k in range(4):
        log(spark).where(F.col("seq").between(4 * k, 4 * k + 3)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(log(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = cache.replay_stream(source, cache.Profile(2, 10.0, 0.95)).writeStream.format("memory").queryName("cached").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert [r.outcome for r in spark.table("cached").orderBy("seq").collect()] == WANT


def test_slots_against_a_plain_cache():
    """Random operations against a list of entries in order of use."""
    r = random.Random(3)
    profile, vectors = cache.Profile(4, 20.0, 0.9), [None, [0.0, 0.0], [1.0, 0.0], [1.0, 0.2], [0.0, 1.0], [0.3, 1.0], [2.0, 0.0]]
    entries, slots, now, order = [], cache.Slots(profile), 0.0, 0

    def cosine(a, b):
        na, nb = (sum(x * x for x in v) ** 0.5 for v in (a, b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0

    for step in range(3000):
        now += r.choice([0.0, 1.0, 3.0])
        op, query, vector = r.choice(["get"] * 6 + ["put"] * 4 + ["drop"]), f"q{r.randrange(7)}", r.choice(vectors)
        if op == "get":
            entries = [e for e in entries if now - e["created"] <= profile.ttl_seconds]
            hit, kind = next((e for e in entries if e["query"] == query), None), "l1"
            if hit is None and vector is not None and any(vector):
                near = [(-cosine(e["vector"], vector), e["order"], e["query"], e) for e in entries]
                near = sorted(near, key=lambda x: (round(x[0], 12), x[1]))
                hit, kind = (near[0][3], "l2") if near and -near[0][0] >= profile.threshold else (None, "miss")
            kind = kind if hit else "miss"
            if hit:
                entries.remove(hit)
                entries.append(hit)
            assert slots.look_up(now, query, vector) == (kind, hit["result"] if hit else None), step
        elif op == "put":
            order += 1
            known = [e for e in entries if e["query"] == query]
            entries = [e for e in entries if e["query"] != query]
            entries.append({"query": query, "vector": vector or [0.0, 0.0], "result": str(step), "created": now, "order": order})
            if not known and len(entries) > profile.max_entries:
                entries.pop(0)
            slots.store(now, query, vector, str(step))
        elif r.random() < 0.2:
            query = query if r.random() < 0.7 else None
            entries = [] if query is None else [e for e in entries if e["query"] != query]
            slots.forget(query)
        assert len(entries) == len(slots.place)
        if step % 50 == 0:
            slots = cache.Slots.restored(profile, slots.state())


def test_streams_forget_idle_groups(spark, tmp_path):
    rows = [(1, "a", 1.0, "start"), (2, "a", 2.0, "start"), (3, "b", 40_000.0, "start"), (4, "b", 90_000.0, "start"), (5, "a", 100_000.0, "start")]
    for k, row in enumerate(rows):
        frame(spark, [row]).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = admission.admit_stream(source, 5, 2).writeStream.format("memory").queryName("idle").trigger(availableNow=True)
    query.option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    # Two requests of a run on without end; a day later they are forgotten, or the last one would be rejected.
    assert {r.request_id: r.admitted for r in spark.table("idle").collect()} == {i: True for i in range(1, 6)}


def test_ingest_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(5):
        (docs / f"{i}.txt").write_text(f"document {i} " * 300)
    (docs / "short.txt").write_text("short")
    table, checkpoint = f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    ingest.ingest(ingest.text_stream(spark, str(docs), 2), table, checkpoint).awaitTermination()
    n = spark.read.parquet(table).count()
    assert spark.read.parquet(table).select("source").distinct().count() == 5
    (docs / "new.txt").write_text("another document " * 50)
    ingest.ingest(ingest.text_stream(spark, str(docs), 2), table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == n + 1
    ingest.ingest(ingest.text_stream(spark, str(docs), 2), table, f"{tmp_path}/other").awaitTermination()
    assert spark.read.parquet(table).count() == n + 1


def test_null_limits_are_the_defaults(spark):
    requests = spark.range(80).selectExpr("id AS request_id", "'t' AS tenant_id", "timestamp_seconds(id / 1000) AS ts", "'start' AS kind")
    tenants = spark.createDataFrame([("t", None, None)], "tenant_id string, max_requests_per_min int, max_concurrent int")
    assert admission.admit(requests, tenants).where("admitted").count() == 50
    ended = requests.unionByName(requests.selectExpr("request_id + 1000 AS request_id", "tenant_id", "ts", "'end' AS kind"))
    assert admission.admit(ended, tenants).where("admitted AND kind = 'start'").count() == 60
    assert admission.admit(requests, tenants.limit(0)).where("admitted").count() == 0
