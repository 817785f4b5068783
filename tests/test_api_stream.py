"""The paged API as a stream: offsets are pages, and a restart repeats none."""

from loamstone.sources import api

LENGTHS = {"linux": 3, "python": 1, "empty": 0, "skipped": 5}


def questions(name, page):
    """Pages of two items; a name is a folder, where every request is noted, and a topic. `grows` has as many pages as a file says."""
    folder, _, topic = name.rpartition("/")
    if folder:
        with open(f"{folder}/log", "a") as f:
            f.write(f"{topic}/{page}\n")
    last = LENGTHS.get(topic)
    if last is None:
        with open(f"{folder}/length") as f:
            last = int(f.read())
    return [{"title": f"{topic}{page}{i}", "tags": [topic], "body": "x", "votes": i} for i in range(2)] if page <= last else []


def read(spark, tmp_path, topics, skip="", **options):
    spark.dataSource.register(api.ApiSource)
    inside = lambda names: ",".join(f"{tmp_path}/{t}" for t in names.split(",") if t)
    options |= {"topics": inside(topics), "skip": inside(skip), "fetch": "tests.test_api_stream:questions"}
    stream = spark.readStream.format("topic_api").options(**options).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
    query.processAllAvailable()
    query.stop()
    titles = sorted(r.title for r in spark.read.parquet(f"{tmp_path}/out").collect())
    asked = (tmp_path / "log").read_text().split()
    (tmp_path / "log").write_text("")
    return titles, asked


def test_a_restart_repeats_no_page(spark, tmp_path):
    length = tmp_path / "length"
    length.write_text("2")
    topics = "linux,python,empty,skipped,grows,linux"
    titles, asked = read(spark, tmp_path, topics, skip="skipped,other")
    want = [f"{t}{p}{i}" for t, n in (("linux", 3), ("python", 1), ("grows", 2)) for p in range(1, n + 1) for i in range(2)]
    assert titles == sorted(want) and not any(a.startswith("skipped") for a in asked)
    assert all(asked.count(f"linux/{p}") == 1 for p in (1, 2, 3))
    length.write_text("4")  # more has come since
    titles, asked = read(spark, tmp_path, topics, skip="skipped")
    assert titles == sorted(want + [f"grows{p}{i}" for p in (3, 4) for i in range(2)])
    assert not {"linux/1", "linux/2", "linux/3", "python/1", "grows/1", "grows/2"} & set(asked)


def test_limits_and_batches(spark, tmp_path):
    titles, asked = read(spark, tmp_path, "linux,empty", pages="2")
    assert len(titles) == 4 and "linux/3" not in asked
    reader = api.ApiStreamReader({"topics": "linux,python", "fetch": "tests.test_api_stream:questions"})
    rows, end = reader.read({"linux": 1})
    assert end == {"linux": 2, "python": 1} and [r[1] for r in rows] == ["linux20", "linux21", "python10", "python11"]
    assert [r[1] for r in reader.readBetweenOffsets({"linux": 1}, end)] == ["linux20", "linux21", "python10", "python11"]
    assert reader.read({"linux": 3, "python": 1})[1] == {"linux": 3, "python": 1}
