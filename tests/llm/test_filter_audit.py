import itertools
from collections import defaultdict

from pyspark.sql import functions as F

from loamstone.llm import filter_audit
from tests.llm.helpers import SPACE

LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]


def brute(rows, labels):
    """Every document through every order, one filter after the other."""
    marks = defaultdict(set)
    for i, quality, toxic in labels:
        marks[i] |= ({"good"} if quality == 1 else set()) | ({"toxic"} if toxic == 1 else set())
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        w, fails = words(t), set()
        fails |= {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > lowest[t] else set()
        parts[lang or ""].append((fails, marks.get(i, set()) if i is not None else set()))
    out = []
    for part, docs in parts.items():
        mine, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                fail = sum(x in f for f, _ in docs)
                good, toxic = (sum(k in m for _, m in gone) for k in ("good", "toxic"))
                shapley[x] += len(gone)
                mine.append(((part, "".join(order), step, len(left), len(gone), fail - len(gone), sum(f == {x} for f, _ in docs), good, toxic), x))
        out += [(*row, shapley[x]) for row, x in mine]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"w{i}" for i in range(120))


def rows():
    out = [(1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, None, "de"), (5, "", None), (6, "", "")]
    out += [(7, LONG.upper(), "en"), (8, LONG.upper(), None), (9, "Ab | c", "en"), (10, "x " * 200, "en"), (None, LONG, "en"), (None, LONG, "fr")]
    out += [(None, "only here", "fr"), (11, "\x0b\x0c\r\t  ", "fr"), (12, "É" * 9 + "A", "fr"), (13, "É" * 8 + "AA", "fr"), (14, LONG.replace("w1 ", "W1 "), "de")]
    out += [(15, " ".join(["a"] * 150), "de"), (16, LONG + " $", "de"), (16, LONG + " $", "de"), (17, "z" * 300_000, "de"), (18, LONG + " $", "en")]
    out += [(100 + i, LONG, "en") for i in range(40)]
    return out


def marks():
    return [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (4, 1, None), (10, 1, 1), (None, 1, 1), (16, 1, 0), (999, 1, 1), (104, 1, 0)]


def table(spark, given):
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string")
    for name in ("mask", "n", "digest", "part", "words", "good", "low"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def test_against_brute_force(spark):
    found = filter_audit.audit(table(spark, rows()), spark.createDataFrame(marks(), LABELS))
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == brute(rows(), marks())


def test_empty_tables(spark):
    assert filter_audit.audit(table(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    found = filter_audit.audit(table(spark, rows()), spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == brute(rows(), [])


def test_zeta_counts_all_subsets(spark):
    counts = {m: (m * 7) % 11 for m in range(32) if m % 3}
    frame = spark.createDataFrame([("p", m, n, n, 0) for m, n in counts.items()], "part string, mask int, n long, good long, toxic long")
    made = filter_audit.survivors(frame, 5).first()
    assert made["n"] == [sum(n for m, n in counts.items() if m | t == t) for t in range(32)]
    assert made["good"] == made["n"] and not any(made["toxic"])


def test_filters_of_ones_own(spark):
    own = lambda text, words: {"X": F.size(words) < 3}
    docs = table(spark, [(1, "a b c", "en"), (2, "a", "en"), (3, "a", "en")])
    found = filter_audit.audit(docs, spark.createDataFrame([], LABELS), filters=own)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found.collect()}
    assert got == {("XE", 1): (1, 2, 0, 1, 3), ("XE", 2): (1, 0, 1, 0, 1), ("EX", 1): (2, 1, 0, 0, 1), ("EX", 2): (1, 1, 1, 1, 3)}


def test_no_text_is_shuffled(spark):
    plan = filter_audit.audit(table(spark, rows()), spark.createDataFrame(marks(), LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan
