"""The stored vector index against a comparison with everything."""

import numpy as np
import pytest

from loamstone.operators import cells, joins, ranking
from tests.measures import shuffled


def frame(spark, m, name, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, vector array<double>")


def same(spark, tmp_path, rows, asked, k, n_cells=None):
    chunks, questions = frame(spark, rows, "id"), frame(spark, asked, "qid")
    cells.build(chunks, f"{tmp_path}/index", cells=n_cells)
    found = cells.search(questions, f"{tmp_path}/index", k, f"{tmp_path}/scratch")
    key = lambda df: sorted((r.qid, r["rank"], r.id, round(r._distance, 9)) for r in df.collect())
    assert key(found) == key(ranking.top_k_join(questions, chunks, k))
    return found


def clustered(r, n, dims=8, clusters=20):
    middles = r.normal(size=(clusters, dims)) * 10
    return middles[r.integers(0, clusters, n)] + r.normal(size=(n, dims)) * 0.3


def test_clustered_vectors_are_found_in_few_cells(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = clustered(r, 3000)
    same(spark, tmp_path, rows, rows[::100] + 0.01, 5, 40)
    seen = cells.visited(f"{tmp_path}/index", f"{tmp_path}/scratch", spark, 5).collect()
    assert len(seen) == 30 and max(x.n_vectors for x in seen) < 3000 / 4 and max(x.n_cells for x in seen) < 12


@pytest.mark.parametrize("k", [1, 7])
def test_unstructured_vectors_lose_no_neighbour(spark, tmp_path, k):
    r = np.random.default_rng(2)
    same(spark, tmp_path, r.normal(size=(400, 16)), r.normal(size=(30, 16)), k)


def test_large_cells_many_questions_and_ties(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 50)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    r = np.random.default_rng(3)
    rows = np.concatenate([np.repeat([[1.0, 2.0]], 300, axis=0), r.integers(1, 4, size=(200, 2)).astype(float)])
    same(spark, tmp_path, rows, np.concatenate([np.repeat([[1.0, 2.0]], 60, axis=0), [[0.0, 0.0], [9.0, 9.0]]]), 3)


def test_fewer_vectors_than_asked_for_and_empty_tables(spark, tmp_path):
    same(spark, tmp_path / "a", np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[1.0, 1.0]]), 9)
    none = frame(spark, [], "id")
    cells.build(none, f"{tmp_path}/b")
    assert cells.search(frame(spark, [[1.0]], "qid"), f"{tmp_path}/b", 3, f"{tmp_path}/c").count() == 0
    assert cells.search(frame(spark, [], "qid"), f"{tmp_path}/a/index", 3, f"{tmp_path}/d").count() == 0


def test_only_visited_cells_are_read(spark, tmp_path):
    rows = clustered(np.random.default_rng(4), 500)
    cells.build(frame(spark, rows, "id"), f"{tmp_path}/index", cells=20)
    table = spark.read.parquet(f"{tmp_path}/index/vectors")
    assert table.count() == 500 and table.select("cell").distinct().count() > 10
    assert "PartitionFilters: [isnotnull(cell" in table.where("cell = 3")._jdf.queryExecution().executedPlan().toString()


def test_most_similar_entry_of_a_cache_of_any_size(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = r.normal(size=(300, 6)) * r.uniform(0.1, 9, size=(300, 1))
    asked = np.concatenate([rows[:20] * 3, r.normal(size=(30, 6)), np.zeros((1, 6))])
    entries, questions = frame(spark, rows, "entry"), frame(spark, asked, "qid")
    cells.build(cells.unit(entries), f"{tmp_path}/index", key="entry")
    found = cells.nearest_stored(questions, f"{tmp_path}/index", 0.5, f"{tmp_path}/scratch")
    key = lambda df: sorted((r.qid, r.entry, round(r.similarity, 9)) for r in df.collect())
    assert key(found) == key(joins.nearest_cached(questions, entries, 0.5))


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_many_blocks_and_shelves_with_copies(spark, tmp_path, monkeypatch, k, broadcast):
    """Shelves and blocks of a few vectors, joined either way; entries and questions that are equal, one of them far more often than a part holds."""
    monkeypatch.setattr(cells, "SHELF_BYTES", 2_000)
    monkeypatch.setattr(cells, "PART_ROWS", 40)
    monkeypatch.setattr(cells, "PRODUCT", 100)
    r = np.random.default_rng(6)
    rows = r.normal(size=(250, 16))
    rows = np.concatenate([rows, rows[:60], np.repeat(rows[:1], 150, axis=0)])
    asked = np.concatenate([rows[:80], rows[:30], r.normal(size=(60, 16)), clustered(r, 20, 16)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        same(spark, tmp_path, rows, asked, k)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    known = cells._Cells(cells.cells_of(spark, f"{tmp_path}/index"))
    assert len(set(known.shelves().tolist())) > 10 and known.parts.max() > 1


def test_what_is_sent_grows_with_the_vectors_and_not_with_the_visits(spark, tmp_path):
    """Vectors without structure, of which each question visits nearly all cells: questions went to each of them."""
    rows = frame(spark, np.random.default_rng(7).normal(size=(3000, 16)), "id").localCheckpoint()
    cells.build(rows, f"{tmp_path}/index")
    questions = rows.withColumnRenamed("id", "qid")
    sent = shuffled(spark, lambda: cells.search(questions, f"{tmp_path}/index", 2, f"{tmp_path}/scratch"))
    seen = cells.visited(f"{tmp_path}/index", f"{tmp_path}/scratch", spark, 2).groupBy().avg("n_cells").first()[0]
    assert seen > 20 and 0 < sent < 8 * 3000 * 16 * 8


def test_cells_that_no_question_reaches_are_not_shelved(spark, tmp_path):
    rows = clustered(np.random.default_rng(8), 2000)
    cells.build(frame(spark, rows, "id"), f"{tmp_path}/index", cells=40)
    found = cells.search(frame(spark, rows[:3], "qid"), f"{tmp_path}/index", 2, f"{tmp_path}/scratch")
    assert found.count() == 6
    assert 6 <= spark.read.parquet(f"{tmp_path}/scratch/shelves").selectExpr("sum(octet_length(ids)) / 8").first()[0] < 1000
