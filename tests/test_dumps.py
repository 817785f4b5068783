"""Dumps that are read by many tasks: the rows are those of a reader that takes the file as a whole."""

import bz2
import gzip
import html
import random
import xml.etree.ElementTree as ET

import pytest

from loamstone import schema
from loamstone.sources import files

HEAD = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">\n  <siteinfo><sitename>x</sitename><pagesize>3</pagesize></siteinfo>\n'
PAGE = "  <page>\n    <title>{}</title>\n    <ns>0</ns>\n    <revision><id>1</id><text xml:space=\"preserve\">{}</text></revision>\n  </page>\n"


def pages(n, seed=1):
    r = random.Random(seed)
    words = ["alpha", "<page>", "</page>", "é", "日本", "&", "\n", "<row", "/>", "𝄞"]
    return [(f"T {i} <&>", " ".join(r.choice(words) + str(r.random()) for _ in range(r.randint(0, 60)))) for i in range(n)]


def dump(rows):
    return (HEAD + "".join(PAGE.format(html.escape(t), html.escape(x)) for t, x in rows) + "</mediawiki>\n").encode()


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def as_read(df):
    return sorted((r.title, r.text or "") for r in df.collect())


def test_plain_dump_is_many_tasks(spark, tmp_path, small_splits):
    want = pages(3000)
    (tmp_path / "d.xml").write_bytes(dump(want))
    whole = spark.read.format("xml").option("rowTag", "page").schema(schema.WIKI_PAGE).load(f"{tmp_path}/d.xml")
    assert sorted((r.title, r.revision.text or "") for r in whole.collect()) == sorted((t, x.strip()) for t, x in want)
    counts = []
    for n in (1 << 30, 300_000, 77_777, 4_099):  # also splits shorter than a page
        small_splits(n)
        read = files.wiki_dump(spark, f"{tmp_path}/d.xml")
        counts.append(read.rdd.getNumPartitions())
        assert as_read(read) == sorted((r.title, r.revision.text or "") for r in whole.collect())
    assert counts == sorted(counts) and counts[-1] > 40 * counts[0]


@pytest.mark.parametrize("streams", [1, 40])
def test_bzip2_dumps_are_many_tasks(spark, tmp_path, small_splits, streams):
    """In one stream and, like multistream dumps, in many, each of its own pages."""
    want = pages(9000, 2)
    data = dump(want)
    cuts = [len(data) * i // streams for i in range(streams + 1)]
    (tmp_path / "d.xml.bz2").write_bytes(b"".join(bz2.compress(data[a:b], 1) for a, b in zip(cuts, cuts[1:], strict=False)))
    small_splits(200_000)
    read = files.wiki_dump(spark, f"{tmp_path}/d.xml.bz2")
    sizes = read.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in sizes) > 4 and sum(sizes) == 9000
    assert as_read(read) == sorted((t, x.strip()) for t, x in want)


def test_gzip_and_broken_dumps(spark, tmp_path):
    want = pages(50, 3)
    (tmp_path / "d.xml.gz").write_bytes(gzip.compress(dump(want)))
    assert len(as_read(files.wiki_dump(spark, f"{tmp_path}/d.xml.gz"))) == 50
    cut = dump(want)
    (tmp_path / "cut.xml").write_bytes(cut[: cut.rindex(b"</text>")])
    assert len(as_read(files.wiki_dump(spark, f"{tmp_path}/cut.xml"))) == 49
    (tmp_path / "none.xml").write_bytes(HEAD.encode() + b"</mediawiki>")
    (tmp_path / "empty.xml").write_bytes(b"")
    assert files.wiki_dump(spark, f"{tmp_path}/none.xml").count() == files.wiki_dump(spark, f"{tmp_path}/empty.xml").count() == 0
    (tmp_path / "latin.xml").write_bytes(dump([("A", "x")]).replace(b"x</text>", b"x\xff y</text>"))
    assert [t for t, _ in as_read(files.wiki_dump(spark, f"{tmp_path}/latin.xml"))] == ["A"]


def test_posts_are_many_tasks(spark, tmp_path, small_splits):
    rows = [{"Id": str(i), "PostTypeId": "1", "Score": "5", "Title": f"a /> b > {i} <row", "Body": f"<p>\n{'w ' * (i % 90)}</p>", "Tags": "<a><b>"} for i in range(4000)]
    root = ET.Element("posts")
    for r in rows:
        ET.SubElement(root, "row", r).tail = "\n"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "Posts.xml").write_bytes(ET.tostring(root).replace(b"&gt;", b">"))
    small_splits(30_000)
    read = files.posts(spark, f"{tmp_path}/s/Posts.xml")
    assert read.rdd.getNumPartitions() > 10
    got = sorted(((r._Id, r._Title, r._Tags, r.site) for r in read.collect()))
    assert got == sorted((r["Id"], r["Title"], r["Tags"], "s") for r in rows)
