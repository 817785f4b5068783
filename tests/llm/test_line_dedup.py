import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from loamstone.llm import line_dedup
from loamstone.llm.common import sorted_reads
from tests.llm.helpers import SPACE, ascii_lower, docs

LONG = "This is a line of more than forty characters in all"


def brute(rows, min_docs=5, min_chars=40):
    key = lambda line: ascii_lower(line.strip(SPACE))
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where[key(x)]) >= min_docs and max(where[key(x)]) != (-1 if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    out = [(i, f"start {i}\n  {LONG.upper() if i % 2 else LONG}\t\n{LONG}É\nshort") for i in range(8)]
    out += [(8, None), (9, ""), (None, LONG), (10, "\n\n" + LONG), (3, LONG), (11, LONG + "\n" + LONG), (12, LONG.replace("k", "K"))]
    out += [(13, LONG + "é"), (14, "x" * 300_000), (15, "\n".join(f"line {i} " + LONG for i in range(300))), (16, LONG), (16, LONG)]
    return out


def found(df):
    made = df.selectExpr("row.doc_id", "size(lines)", "size(lines) - size(kept)", "sha2(cast(array_join(kept, '\n') as binary), 256)")
    return sorted(map(tuple, made.collect()), key=repr)


def test_against_brute_force(spark):
    for batches, fanout in ((1, 4), (4, 2), (7, 3)):
        df = line_dedup.drop_repeated_lines(docs(spark, rows()), batches=batches, fanout=fanout)
        assert found(df) == brute(rows())


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


def test_texts_keep_their_columns(spark):
    before = docs(spark, rows())
    after = line_dedup.without_repeated_lines(before)
    assert after.columns == before.columns
    kept = {r.doc_id: r for r in after.where("doc_id in (0, 8, 9)").collect()}
    assert kept[8].text is None and kept[8].n_chars is None and kept[9].text == ""
    assert kept[0].n_chars == len(kept[0].text) and LONG + "\n" not in kept[0].text and kept[0].row == "x"


def batches_of(spark):
    for lo in (30, 20, 10, 0):
        yield line_dedup.postings_of(docs(spark, [(lo + i, f"{LONG}\n{LONG} {lo + i}") for i in range(3)]), [], 40)


def test_runs_are_compacted(spark):
    store, sizes = line_dedup.LineRuns(spark, fanout=2), []
    for postings in batches_of(spark):
        store.ingest(postings)
        sizes.append([len(level) for level in store.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1]]
    top = store.repeated().collect()
    assert len(top) == 1 and top[0]["last"] == 32
    assert store.runs()[0].where(F.col("last") == 32).count() == 2  # the repeated line, decided in the second level, and a line of its own


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_neither_shuffled_nor_sorted(spark):
    """Merge-anti-joins and merges read buckets as they lie; only the batch itself is shuffled."""
    store, postings = line_dedup.LineRuns(spark, fanout=3), list(batches_of(spark))
    store.ingest(postings[0])
    store.ingest(postings[1])
    with sorted_reads(spark):
        join = plan_of(store.undecided(postings[2]))
        merge = plan_of(store.merged(*store.runs()))
    assert join.count("SortMergeJoin") == 2 and join.count("Bucketed: true") == 2
    run_lines = [line for line in join.splitlines() if "Bucketed: true" in line]
    lines = join.splitlines()
    for line in run_lines:  # from the scan up to its join there is a filter and a projection, no more
        at, up = lines.index(line), []
        for above in reversed(lines[:at]):
            depth = len(above) - len(above.lstrip(" :+-"))
            if depth < len(line) - len(line.lstrip(" :+-")) - 3 * len(up):
                up.append(above.strip(" :+-").split(" ")[0])
                if "SortMergeJoin" in above:
                    break
        assert "Exchange" not in up and "Sort" not in up
    assert "Exchange" not in merge and " Sort " not in merge and merge.count("Bucketed: true") == 2


def test_texts_are_read_twice_however_many_batches(spark, monkeypatch):
    hashed = []
    real = line_dedup.postings_of
    monkeypatch.setattr(line_dedup, "postings_of", lambda *a: hashed.append(1) or real(*a))
    for batches in (1, 6):
        hashed.clear()
        assert found(line_dedup.drop_repeated_lines(docs(spark, rows()), batches=batches)) == brute(rows())
        assert len(hashed) == 1


def test_lines_whose_64_bit_hashes_are_made_to_collide(spark):
    a = "h/v^.~-6the same middle part xyz!9_~+nbvand the same end as well"
    b = "{}16?_)mthe same middle part xyz/x}]65z3and the same end as well"
    given = [(i, a + ("\n" + b if i == 1 else "")) for i in range(1, 6)]
    hashes = {r[0] for r in spark.createDataFrame([(a,), (b,)], "x string").select(F.xxhash64("x")).collect()}
    assert len(hashes) == 1
    made = found(line_dedup.drop_repeated_lines(docs(spark, given)))
    assert made == brute(given) and made[0][:3] == (1, 2, 1)
