import random
import re

from loamstone.llm import common, decontaminate
from tests.llm.helpers import ascii_lower, docs, random_texts


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(len(w), 10) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    spans = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for s in spans:
            for k in range(len(w) - s + 1):
                if (g := tuple(w[k : k + s])) in windows:
                    hit |= set(range(k, k + s))
                    found |= windows[g] - {"None"}
        if hit:
            out.append((d, len(hit), tuple(sorted(found))))
    return sorted(set(out), key=repr)


def tables():
    r = random.Random(2)
    items = list(enumerate(random_texts(20, 7, length=30)))
    items += [(90, None), (91, ""), (92, "one. Two"), (93, "É"), (3, "another text of item three that is long enough to have windows"), (None, "a null item with enough words in it for a window")]
    rows = list(enumerate(random_texts(60, 8, length=60)))
    for i in range(60, 90):
        w = words(r.choice(items[:20])[1])
        a = r.randint(0, len(w))
        rows.append((i, " , ".join(["x", *w[a : a + r.randint(5, 14)], "y"]).upper()))
    rows += [(100, None), (101, ""), (102, "... one,two ..."), (103, "É é"), (None, "ONE two"), (104, "one two"), (104, "one two"), (104, "none")]
    rows += [(105, "a NULL item with enough words in it for a window!"), (106, "word " * 30_000 + "one two")]
    return rows, items


def found(df):
    return sorted(((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows, items = tables()
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    for limit in (200_000, 0):  # with broadcasts and without
        assert found(decontaminate.contamination(docs(spark, rows), table, broadcast_rows=limit)) == brute(rows, items)


def test_only_long_items(spark):
    rows, items = tables()
    items = [(i, t) for i, t in items if len(words(t)) >= 10]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.contamination(docs(spark, rows), table)) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = tables()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, rows), none).count() == 0
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), table).count() == 0


def test_contaminated_rows_go(spark):
    rows, items = tables()
    table = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.without_contaminated(docs(spark, rows), table)
    bad = {d for d, _, _ in brute(rows, items)}
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (d for d, t in rows if d not in bad or (d, t) == (104, "none")), key=repr
    )


def test_a_passage_of_many_documents_and_items_makes_a_row_a_document(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"before{i} {passage} after{i}") for i in range(40)]
    items = [(i, f"{passage} item{i} " + " ".join(f"own{i}w{k}" for k in range(9))) for i in range(40)]
    sizes, real = {}, decontaminate.materialise

    def watched(df, label, **options):
        out = real(df, label, **options)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialise", watched)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.contamination(docs(spark, rows), table)) == brute(rows, items)
    assert sizes["windows"] == 21 + 40 * 10  # the shared windows once, and each item's own
    assert sizes["hits"] == 40


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    rows, items = tables()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert not common.fits(spark.range(7), 100) and common.fits(spark.range(6), 100)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.contamination(docs(spark, rows), table)) == brute(rows, items)
