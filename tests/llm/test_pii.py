import hashlib
import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from loamstone.llm import pii
from tests.llm.helpers import docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=3000, deadline=None)
@given(st.one_of(st.text(alphabet="a@.-+ 10(25b_%é\n", max_size=40), st.text(alphabet="0123456789 -.+@", max_size=60)))
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("1" * 300_000, "1." * 100_000, "a@" * 100_000, "a" * 300_000 + "@", "+1 " * 100_000, "4 " * 100_000):
        pii.base_spans(text)
    assert time.time() - start < 10


FILL = "common words stand here and there with others between them all"


OTHERS = ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")


def rows():
    out = [(i, f"{FILL} {i} zorblatt says write to boss@corp{'.example'} about {OTHERS[i]} {FILL}") for i in range(6)]
    out += [(10 + i, f"{FILL} number {i}") for i in range(30)]
    out += [(50, "a mention of Zorblatt alone"), (51, None), (52, ""), (None, "x@y.zz"), (53, "😀 x@y.zz 1.2.3.4"), (53, "again"), (54, "w " * 100_000)]
    return out


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_rows_and_disclosing_terms(spark):
    found = pii.find(docs(spark, rows()), with_text=True, bits=1.0).collect()
    assert len(found) == len(rows())
    by = {(r.doc_id, r.base_sha256): r for r in found}
    for i, t in rows():
        base = brute(t or "")
        r = by[i, hashlib.sha256(written(base).encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, written(base).split(","))) <= set(r.spans.split(","))
    alone = next(r for r in found if r.doc_id == 50)
    assert alone.spans == "term:13:21" and "orblatt" not in alone.clean
    assert next(r for r in found if r.doc_id == 10).spans == ""
    assert "boss@" not in next(r for r in found if r.doc_id == 0).clean


def test_without_broadcasts_and_empty(spark):
    key = lambda df: sorted(map(repr, df.collect()))
    table = docs(spark, rows())
    assert key(pii.find(table, broadcast_rows=0)) == key(pii.find(table))
    assert pii.find(docs(spark, [])).count() == 0


def test_names_beside_rare_values_at_production_thresholds(spark):
    """Values that occur once or twice disclose too; words of other texts, and words by many values, do not."""
    table = [(i, f"{FILL} {i} kontakt quiblark under jane@corp{'.example'} {FILL} {i}") for i in range(2)]
    table += [(5, f"{FILL} vexholm at vx@corp{'.example'}, phone +1 (555) 123-4567 {FILL}")]
    table += [(10 + i, f"{FILL} kontakt user{i}@corp{'.example'} nearby {FILL}") for i in range(4)]
    table += [(20 + i, f"{FILL} plain nearby text {i}") for i in range(100)]
    found = {r.doc_id: r.spans for r in pii.find(docs(spark, table)).collect()}
    text = dict(table)
    terms = lambda i: {text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k == "term"}
    assert [terms(0), terms(1), terms(5)] == [{"quiblark", "under"}, {"quiblark", "under"}, {"vexholm", "phone", "at"}]
    assert not any(terms(i) for i in text if i >= 10)


def test_estimates_against_brute_force(spark):
    """The texts that hold flagged terms, by plain counting; thresholds as in production."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(3 + k % 3)) for k in range(400)]
    table = []
    for i in range(300):
        body = [words[min(int(r.expovariate(0.01)), 399)] for _ in range(12)]
        for _ in range(r.choice((0, 0, 1, 2))):
            body.insert(r.randrange(len(body)), f"+1 (555) 000-{r.randrange(60):04}" if r.random() < 0.5 else f"u{r.randrange(30)}@corp{'.example'}")
        table.append((i, " ".join(body)))
    assert_brute(spark, table)


def terms_by_brute(table, n=8):
    """doc_id -> the spans of terms, by plain counting over whole texts; thresholds as in production."""

    def around(t, spans, s):
        free = [m for m in re.finditer(r"[^\W_]+", t) if all(m.end() <= a or m.start() >= b for a, _, b in spans)]
        return tuple(sorted({m[0].lower() for m in [m for m in free if m.end() <= s[0]][-n:] + [m for m in free if m.start() >= s[2]][:n]}))

    near, texts, seen = {}, {}, {}
    for _, t in table:
        spans = brute(t)
        for w in {m[0].lower() for m in re.finditer(r"[^\W_]+", t)}:
            texts.setdefault(w, set()).add(t)
        for s in spans:
            value = t[s[0] : s[2]]
            e = (s[1], value.lower() if s[1] < 2 else re.sub(r"[^0-9]", "", value))
            context = around(t, spans, s)
            seen.setdefault(e, set()).add((context, t))
            for w in context:
                near.setdefault((e, w), set()).add((context, t))
    total, flagged = len({t for _, t in table}), {}
    count = lambda pairs, at: len({p[at] for p in pairs})
    for (e, w), pairs in near.items():
        n_t, n_c = len(texts[w]), sum(count(p, 0) for (_, v), p in near.items() if v == w)
        mates = [p for (d, v), p in near.items() if v == w and d[0] == e[0]]
        x_k = len({p[1] for d, ps in seen.items() if d[0] == e[0] for p in ps})
        share = count(pairs, 1) / sum(count(p, 1) for p in mates) * (count(set().union(*mates), 1) + x_k / total) / (n_t + 1)
        if count(pairs, 0) >= 3:
            share = max(share, count(pairs, 0) / max(n_t, n_c))
        if share >= 0.5 and math.log2(share * total / count(seen[e], 0)) >= 4:
            flagged[w] = max(flagged.get(w, 0), share)
    return {i: [(m.start(), 4, m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in flagged] for i, t in table}, flagged


def assert_brute(spark, table):
    want, flagged = terms_by_brute(table)
    assert flagged
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, table)).collect()}
    for i, t in table:
        assert got[i] == written(sorted([*brute(t), *want[i]])), i


def test_long_short_and_foreign_words_are_terms(spark):
    """Eight words a side count however long they are; two letters and digits are words; case is folded once."""
    far = " ".join(f"{chr(97 + k)}" * 51 for k in range(5))
    table = [(i, f"{FILL} {i}") for i in range(60)]
    table += [(100, f"Wei {far} Li jd42 wei@corp{'.example'} İSTANBUL straße Σίσυφος {far[:200]} end {FILL}")]
    table += [(101, f"{FILL} İSTANBUL and i̇stanbul"), (102, f"ISTANBUL STRASSE {FILL}"), (103, "Li jd42 1.2.3.4"), (104, "x" * 1000 + f" a@b{'.example'} " + "y" * 1000)]
    assert_brute(spark, table)
    spans = {r.doc_id: r.spans for r in pii.find(docs(spark, table)).collect()}
    text = dict(table)
    found = {text[100][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[100].split(",")) if k == "term"}
    assert {"Wei", "straße", "a" * 51, "e" * 51} <= found
    assert pii.contexts_of("b c 1.2.3.4 d a@b.cc e", pii.base_spans("b c 1.2.3.4 d a@b.cc e"), 2) == [["b", "c", "d", "e"], ["c", "d", "e"]]


def test_texts_of_terms_move_only_as_the_terms(spark):
    """Contexts are found in linear time."""
    start = time.time()
    text = " ".join(f"word{i} u{i}@corp{'.example'}" for i in range(20_000))
    pii.contexts_of(text, pii.base_spans(text), 8)
    assert time.time() - start < 10
