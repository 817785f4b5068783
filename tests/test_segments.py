"""The segmented full-text index against scoring everything."""

import random
from collections import Counter

import pytest

from loamstone.operators import fts, segments
from loamstone.sources import versions


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, [1 / (1 + j) for j in range(40)], k=r.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Rare RARE w0"), (-5, "w1 rare")]


QUESTIONS = [(1, "w0"), (1, "w39"), (2, "rare"), (3, "w3"), (3, "w7"), (3, "nowhere"), (4, "nowhere")]
key = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("width", [16, 4096])
def test_appends_and_merges_equal_a_full_scan(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(segments, "WIDTH", width)
    rows, path = corpus(300), f"{tmp_path}/index"
    parts = [rows[i::6] for i in range(6)]
    asked = spark.createDataFrame(QUESTIONS, "qid int, term string")
    for i, part in enumerate(parts):
        before = set(versions.folders(spark, path, i)) if i else set()
        segments.append(docs(spark, part), path)
        after = versions.folders(spark, path, i + 1)
        assert before < set(after) and len(after) == i + 1  # only a new segment
    whole = docs(spark, rows)
    want = key(fts.bm25(fts.postings(whole), fts.doc_stats(whole), asked, 5))
    for n, step in enumerate((lambda: 0, lambda: segments.merge_levels(spark, path, 3))):
        step()
        found, read = segments.search(spark, path, asked, 5, f"{tmp_path}/s{n}")
        assert key(found) == want
        assert all(r.read <= r.ranges for r in read.collect())
    assert len(segments.sizes(spark, path)) < 3 and sum(segments.sizes(spark, path).values()) == len(rows)


def test_ranges_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "WIDTH", 8)
    rows = [(i, "common " + "filler " * 30) for i in range(400)] + [(1000 + i, "common common rare") for i in range(20)]
    segments.append(docs(spark, rows), f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "common"), (1, "rare"), (2, "filler")], "qid int, term string")
    found, read = segments.search(spark, f"{tmp_path}/i", asked, 3, f"{tmp_path}/s")
    whole = docs(spark, rows)
    assert key(found) == key(fts.bm25(fts.postings(whole), fts.doc_stats(whole), asked, 3))
    used = {r.qid: (r.read, r.ranges) for r in read.collect()}
    assert used[1][0] <= 4 and used[1][1] > 50


def test_levels(spark, tmp_path):
    path = f"{tmp_path}/i"
    for i in range(4):
        segments.append(docs(spark, [(10 * i + j, f"a b{j}") for j in range(4)]), path)
    assert segments.merge_levels(spark, path, 4) == 1 and list(segments.sizes(spark, path).values()) == [16]
    segments.append(docs(spark, [(100, "a")]), path)
    assert segments.merge_levels(spark, path, 4) == 0 and sorted(segments.sizes(spark, path).values()) == [1, 16]


def test_empty_index(spark, tmp_path):
    segments.append(docs(spark, []), f"{tmp_path}/i")
    found, read = segments.search(spark, f"{tmp_path}/i", spark.createDataFrame([(1, "a")], "qid int, term string"), 3, f"{tmp_path}/s")
    assert found.count() == read.count() == 0


def test_blocks_are_made_where_the_texts_are(spark, monkeypatch):
    monkeypatch.setattr(segments, "WIDTH", 16)
    rows = [*corpus(60), (3, "w1 W1 w2"), (7, "x y"), (7, "y z"), (7, "x"), (7, None), (None, "w1")]
    made = segments._laid_out(segments.blocks(docs(spark, rows)))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    counts, lengths = Counter(), Counter()
    for doc, text in rows:
        words = (text or "").lower().split()
        if doc is not None:
            lengths[doc, len(words)] += 1
            counts.update((word, doc, len(words)) for word in words)
    want = {}
    for (word, doc, n), tf in counts.items():
        want.setdefault((word, doc // 16), []).append((doc, n, tf))
    for (doc, n), copies in lengths.items():
        want.setdefault(("", doc // 16), []).extend([(doc, n, 0)] * copies)
    found = {(r.term, r.range): (r.df, r.max_tf, r.min_len, [tuple(e) for e in r.entries]) for r in made.collect()}
    assert found == {k: (len(e), max(x[2] for x in e), min(x[1] for x in e), sorted(e)) for k, e in want.items()}
