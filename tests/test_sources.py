"""Readers and writers on small files of every shape."""

import bz2
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from loamstone.operators import chunking, embed, joins, predicates
from loamstone.sources import api, catalog, files, optional, sinks

PAGE = "<page><title>{}</title><ns>0</ns><revision><text>{}</text></revision></page>"
LONG = "A text that is long enough to be an article of its own, with more than one hundred characters in it, all told."


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_text_trees(spark, tmp_path):
    put(f"{tmp_path}/a/one.txt", b"caf\xc3\xa9 \xff end")
    put(f"{tmp_path}/a/b/two.md", b"two\nlines")
    put(f"{tmp_path}/a/b/three.py", b"x = 1")
    put(f"{tmp_path}/tests/four.txt", b"skipped")
    put(f"{tmp_path}/a/big.py", b"x" * 2000)
    put(f"{tmp_path}/node_modules/m.js", b"skipped")
    got = {os.path.basename(r.source): r.text for r in files.text_tree(spark, str(tmp_path)).collect()}
    assert got == {"one.txt": "café  end", "two.md": "two\nlines"}
    assert files.priority_text(spark, str(tmp_path), ["a/b"]).count() == 1
    own = files.project_files(spark, str(tmp_path), max_bytes=1000)
    assert {os.path.basename(r.source) for r in own.collect()} == {"one.txt", "two.md", "three.py", "four.txt"}
    assert own.where(~F.col("source").startswith("user:")).isEmpty()


def test_wiki_dumps(spark, tmp_path):
    pages = [("One", LONG), ("Two", "#REDIRECT [[One]] " + LONG), ("Drei", "#WEITERLEITUNG [[One]] " + LONG), ("Short", "x"), ("", LONG), ("One", LONG + " &amp; more")]
    xml = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">' + "".join(PAGE.format(*p) for p in pages) + "</mediawiki>"
    put(f"{tmp_path}/d.xml.bz2", bz2.compress(xml.encode()))
    put(f"{tmp_path}/e.xml.gz", gzip.compress(xml.encode()))
    for name in ("d.xml.bz2", "e.xml.gz"):
        read = files.wiki_dump(spark, f"{tmp_path}/{name}")
        assert read.count() == 6
        assert sorted(r.title for r in predicates.wiki_pages(read).collect()) == ["One", "One"]
        assert sorted(str(r.title or "") for r in predicates.wiki_pages(read, batch=False).collect()) == ["", "Drei", "One", "One"]
    ranked = predicates.wiki_pages(read).withColumn("pos", F.length("text"))
    sinks.articles(ranked, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out", wholetext=True).collect()] == [f"# One\n\n{LONG}\n"]


def test_posts(spark, tmp_path):
    row = '<row Id="{}" PostTypeId="{}" {} Title="T" Body="{}" Tags="&lt;a&gt;&lt;b&gt;" />'
    body = "&lt;p&gt;" + "w " * 70 + "&amp;amp; x&lt;/p&gt;"
    rows = [(1, 1, 'Score="3"', body), (2, 2, 'Score="9"', body), (3, 1, 'Score="2"', body), (4, 1, "", body), (5, 1, 'Score=""', body), (6, 1, 'Score="5"', "short")]
    put(f"{tmp_path}/unix.se/Posts.xml", ("<posts>" + "".join(row.format(*r) for r in rows) + "</posts>").encode())
    posts = files.posts(spark, f"{tmp_path}/*/Posts.xml")
    made = predicates.question_posts(posts, F.col("site")).collect()
    assert [r.source for r in made] == ["stackexchange:unix.se:1"]
    assert made[0].text.startswith("# T\n\nTags: a b \n\nw w") and made[0].text.endswith("w & x")
    assert predicates.question_posts(posts, F.col("site"), min_score=0).count() == 4


def test_side_files(spark, tmp_path):
    put(f"{tmp_path}/t.json", json.dumps({"tenants": [{"tenant_id": "a", "name": "A", "api_key_hash": "h"}, {"tenant_id": "b", "max_requests_per_min": 5, "enabled": False}]}).encode())
    got = {r.tenant_id: r for r in files.tenants(spark, f"{tmp_path}/t.json").collect()}
    assert got["a"].max_requests_per_min == 60 and got["a"].enabled and got["b"].max_requests_per_min == 5 and not got["b"].enabled
    sinks.tenants_json(files.tenants(spark, f"{tmp_path}/t.json"), f"{tmp_path}/t2")
    assert {r.tenant_id for r in files.tenants(spark, f"{tmp_path}/t2").collect()} == {"a", "b"}
    put(f"{tmp_path}/i.json", json.dumps({"items": [{"title": "t", "tags": ["x"], "body": "b"}]}, indent=1).encode())
    assert files.api_items(spark, f"{tmp_path}/i.json").first().tags == ["x"]
    put(f"{tmp_path}/s.json", json.dumps({"wiki_queue": ["a"], "so_progress": {"python": 3}, "mdn_done": True}).encode())
    assert files.collector_state(spark, f"{tmp_path}/s.json").first().so_progress == {"python": 3}
    put(f"{tmp_path}/rel/p-1.zip", b"zip")
    assert files.artefacts(spark, f"{tmp_path}/rel").first().sha256 == __import__("hashlib").sha256(b"zip").hexdigest()


def test_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x " * 2000), ("b", "y")], "source string, text string")
    records = chunking.chunk_records(chunking.fixed_chunks(docs))
    path = f"{tmp_path}/table"
    sinks.replace(records, path)
    n = files.table(spark, path).count()
    sinks.append_unseen(records, path)
    assert files.table(spark, path, ["source"]).count() == n
    sinks.append(records, path)
    assert files.table(spark, path).count() == 2 * n
    sinks.compacted(files.table(spark, path), f"{tmp_path}/small")
    assert files.table(spark, f"{tmp_path}/small").count() == 2 * n
    sinks.jsonl(files.table(spark, path), f"{tmp_path}/j")
    assert files.jsonl_chunks(spark, f"{tmp_path}/j").count() == 2 * n
    tenants = spark.createDataFrame([("t", 3), ("u", 1)], "tenant_id string, max_chunks long")
    mine = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "tenant_id string, text string")
    sinks.append_by_tenant(mine, f"{tmp_path}/tenants")
    stored = spark.read.parquet(f"{tmp_path}/tenants")
    assert {r.tenant_id for r in sinks.within_quota(mine.where("text <> 'b'"), stored, tenants).collect()} == {"t"}


def test_catalogues(spark):
    paths = spark.createDataFrame([("wikipedia/a.txt",), ("gutenberg/b.txt",), ("rfcs/c.txt",), ("nowhere/d.txt",)], "path string")
    got = catalog.prioritised(paths, spark).orderBy("ord").collect()
    assert [r.path for r in got] == ["rfcs/c.txt", "wikipedia/a.txt"]
    dumps = catalog.wiki_dumps(spark).orderBy("ord").collect()
    assert len(dumps) == 8 and dumps[0].url.endswith("/dewikibooks/latest/dewikibooks-latest-pages-articles.xml.bz2") and dumps[0].file == "dewikibooks-articles.xml.bz2"
    assert catalog.wiki_dumps(spark, full=True).where("wiki = 'frwiki'").first().url.endswith("/frwiki/latest/frwiki-latest-pages-articles-multistream.xml.bz2")
    state = spark.createDataFrame([([str(i) for i in range(9)], [str(i) for i in range(9)], {"python": 29, "linux": 30})], "wiki_queue array<string>, wiki_done array<string>, so_progress map<string,int>")
    few = catalog.capped(state, 2, 3).first()
    assert few.wiki_queue == ["0", "1"] and few.wiki_done == ["6", "7", "8"]
    assert {tuple(r) for r in catalog.tag_pages(state, ["python", "linux", "rust"]).collect()} == {("python", 30), ("rust", 1)}


def test_sites_with_nested_posts(spark, tmp_path):
    row = '<posts><row Id="{}" PostTypeId="1" Score="5" Title="T" Body="b" Tags="" /></posts>'
    for path, i in (("se/a/Posts.xml", 1), ("se/a/x/Posts.xml", 2), ("se/b/y/Posts.xml", 3), ("se/b/z/Posts.xml", 4), ("se/c/Other.xml", 5)):
        put(f"{tmp_path}/{path}", row.format(i).encode())
    assert sorted((r.site, r._Id) for r in files.site_posts(spark, f"{tmp_path}/se").select("site", "_Id").collect()) == [("a", "1"), ("b", "3")]


def test_passthrough_and_blocked_roots(spark, tmp_path):
    for path in ("gutenberg/a.txt", "wikipedia/b.txt", "rfcs/c.txt", "rfcs/bad.txt"):
        put(f"{tmp_path}/{path}", b"text")
    names = lambda df: sorted(os.path.basename(r.source) for r in df.collect())
    assert names(files.passthrough_text(spark, str(tmp_path))) == ["a.txt"]
    assert names(files.priority_text(spark, str(tmp_path), ["rfcs", "nowhere"], ["bad"])) == ["c.txt"]


def test_articles_that_are_there_stay(spark, tmp_path):
    pages = lambda *rows: spark.createDataFrame(rows, "title string, text string, pos int")
    sinks.articles(pages(("007", "old", 1), ("a/b", "old", 1)), f"{tmp_path}/out")
    sinks.articles(pages(("007", "new", 1), ("a_b", "new", 1), ("c", "new", 1)), f"{tmp_path}/out")
    read = spark.read.schema("value string, name string").text(f"{tmp_path}/out", wholetext=True)
    assert sorted((r.name, r.value.strip().rpartition("\n")[2]) for r in read.collect()) == [("007", "old"), ("a_b", "old"), ("c", "new")]


def test_one_question_is_embedded(spark):
    load = lambda: embed.hashing_model(16)
    want = [float(x) for x in embed.hashing_model(16)(["it: a question"])[0]]
    assert embed.embed_query(spark, " a question", load, names=F.array(F.lit("it"))) == want
    asked = spark.createDataFrame([(1, "x y"), (2, None)], "qid int, query string")
    assert embed.embed_queries(asked, load, batch=1).where("vector IS NOT NULL").count() == 2


def test_patterns_are_a_dimension(spark):
    many = spark.range(5).selectExpr("CAST(id AS STRING) AS pattern")
    with pytest.raises(ValueError, match="at most 4 rows"):
        joins.dimension(many, 4)


def test_a_cache_of_any_size(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5)]) for i in range(60)]
    entries = spark.createDataFrame(rows, "entry long, vector array<double>")
    asked = spark.createDataFrame(rows[:20], "qid long, vector array<double>")
    key = lambda df: sorted((r.qid, r.entry, round(r.similarity, 9)) for r in df.collect())
    assert key(joins.nearest_cached(asked, entries, 0.5, max_entries=7)) == key(joins.nearest_cached(asked, entries, 0.5))


def test_embedding_failures_and_backfill(spark):
    def load():
        good = embed.hashing_model(8)

        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return good(texts)

        return model

    df = spark.createDataFrame([(1, "fine words"), (2, "bad words"), (3, None)], "id int, text string")
    assert sorted(r.id for r in embed.with_vectors(embed.embedded(df, load)).collect()) == [1, 3]
    lazy = embed.embedded(df, load, lazy=True)
    assert lazy.where("vector IS NOT NULL").isEmpty() and embed.backfilled(lazy, load).where("vector IS NOT NULL").count() == 2


def test_anti_join_keeps_duplicates(spark):
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "source string")
    assert joins.unseen(new, new.where("source = 'a'")).count() == 2


def fake_api(topic, page):
    return [{"title": f"{topic} {page} {i}", "tags": [topic], "body": "b", "votes": 10 * page - i} for i in range(3)] if page < 4 else []


def test_topic_api(spark):
    spark.dataSource.register(api.ApiSource)
    read = spark.read.format("topic_api").option("topics", "python,linux").option("fetch", "tests.test_sources:fake_api").load()
    assert read.count() == 18
    best = api.best_of_topic(read, 2).where("topic = 'linux'").orderBy(F.desc("votes")).collect()
    assert [r.title for r in best] == ["linux 3 0", "linux 3 1"]


def test_optional_libraries(spark, tmp_path):
    df = spark.createDataFrame([("'''bold'''",)], "t string")
    assert "bold" in df.select(optional.plain_wikitext(F.col("t"))).first()[0]
    if not optional._has("pypdf"):
        with pytest.raises(ImportError):
            optional.pdf_texts(spark, str(tmp_path))


def test_live_hits(spark):
    hits = spark.createDataFrame([("a", "t", 0.5)], "source string, text string, _distance double")
    live = spark.createDataFrame([("page", "t", None)], "title string, text string, _distance double")
    assert {r.source for r in files.with_live_hits(hits, live, "web").collect()} == {"a", "live:web:page"}
