"""Scalar functions against what they stand for in Python."""

import html
import os
import re

import pytest
from pyspark.sql import functions as F

from loamstone.functions import sources, text, vectors
from loamstone.operators import audit, chunking, domains, joins, predicates, prompts, ranking

WILD = ["", "  a ", " x ", "\x1cb\x1f", "a\tb\n c", "﻿z", "ß ẞ İ", "x" * 40, "😀 y 😀", None]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_strip(spark):
    assert column(spark, WILD, text.strip) == [None if v is None else v.strip() for v in WILD]


def test_strip_html(spark):
    rows = ["a &lt; b and c &gt; d", "&amp;lt;", "<p>x<br/>y</p>&nbsp;", "&eacute; &#233; &#xe9;", "a<b", None, "plain"]
    want = [None if r is None else re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", html.unescape(r))).strip() for r in rows]
    assert column(spark, rows, text.strip_html) == want


def test_short_sources(spark):
    rows = {
        "live:web:page": "page", "live:x": "live:x", "user:/a/b.py": "b.py", "user:b": "user:b", "stackexchange:s:1": "stackexchange:s:1",
        "a/b.txt": "b.txt", "a/" * 20 + "name.tar.gz": "name.tar", " pad ": "pad", "a/" * 20 + ".hidden": ".hidden",
    }
    assert column(spark, list(rows), sources.short) == list(rows.values())


def test_source_classes(spark):
    rows = {
        "/x/Manpages/a": "manpages", "stackoverflow/stackexchange": "stackoverflow", "stackexchange": "stackexchange", "arch-wiki": "archwiki",
        "mdn-web-docs": "mdn", "linux-docs": "linux", "processed/wiki": "wikipedia", "processed": "other", "gutenberg": "gutenberg", "custom_docs": "custom",
    }
    assert column(spark, list(rows), sources.source_class) == list(rows.values())


def test_boosts(spark):
    boosts = [("doc", 1.5), ("document", 2.0), ("x", 0.5)]
    rows = {"DOCUMENT": 1.5, "blocked doc": 0.0, "x": 0.5, "other": 0.95}
    assert column(spark, list(rows), lambda s: sources.boost(s, boosts, ["blocked"])) == list(rows.values())
    df = spark.createDataFrame([(k,) for k in rows], "source string")
    table = spark.createDataFrame([(p, b, i) for i, (p, b) in enumerate(boosts)], "pattern string, boost double, ord int")
    blocked = spark.createDataFrame([("blocked",)], "pattern string")
    assert {r.source: r.boost for r in joins.boosted(df, table, blocked).collect()} == rows


def test_modes_names_and_versions(spark):
    assert column(spark, ["/code  do\nit", "/other x", "x"], lambda q: text.mode_of(q)[0]) == ["code", "support", "support"]
    assert column(spark, ["/code  do\nit", "/other x"], lambda q: text.mode_of(q)[1]) == ["do\nit", "/other x"]
    assert column(spark, ["a/b:ü 9-_", "x" * 200], text.safe_filename) == ["a_b_ü 9-_", "x" * 100]
    assert column(spark, ["<a><b>", None], text.tag_list) == ["a b ", ""]
    newer = spark.sql("SELECT '1.10.0' AS a, '1.9.0' AS b, '1.9' AS c").select(
        text.version_key(F.col("a")) > text.version_key(F.col("b")), text.version_key(F.col("c")) < text.version_key(F.col("b"))
    )
    assert tuple(newer.first()) == (True, True)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<float>, z array<float>, b array<float>")
    a, z, b = (F.col(c) for c in "azb")
    got = df.select(
        vectors.norm(a), vectors.cosine(a, b), vectors.cosine(a, z), vectors.squared_l2(a, b), vectors.normalised(z), vectors.is_usable(z),
        vectors.hamming(vectors.sign_bits(a, 2), vectors.sign_bits(z, 2)),
    ).first()
    assert got[0] == 5 and got[1] == pytest.approx(0.96) and got[2] == 0 and got[3] == 2 and got[4] == [0, 0] and got[5] is False and got[6] == 2


def test_gates(spark):
    rows = ["how to DROP TABLE x", "a bind shell", "hello", "rm -rf /tmp"]
    assert column(spark, rows, predicates.safe_intent) == [False, False, True, False]
    hits = spark.createDataFrame([("x" * 24, "a"), ("x" * 25, "a"), ("x" * 25, "b.PNG"), (None, "a"), ("x" * 25, None)], "text string, source string")
    assert [r[0] for r in hits.select(predicates.low_quality(F.col("text"), F.col("source"))).collect()] == [True, False, True, True, False]
    done = spark.createDataFrame([(["Datenschutz", "x Datenschutz", "Datenbank", "aadaten", "Linux", "12345daten"],)], "d array<string>")
    assert done.select(predicates.pruned_queue(F.col("d"))).first()[0] == ["Linux", "12345daten"]


def test_rerank_keeps_the_first_of_a_prefix(spark):
    same = "p" * 200
    rows = [
        (1, same + " one of the hits", "s", 1.0), (2, same + " with a better score", "s", 0.0), (3, "other text that is long enough", "s", None),
        (4, "blocked text that is long enough", "bad", 0.0), (5, "image text that is long enough", "a.jpg", 0.0), (6, "short", "s", 0.0),
        (7, "tied text that is long enough: a", "s", 0.5), (8, "tied text that is long enough: b", "s", 0.5),
    ]
    hits = spark.createDataFrame(rows, "in_rank int, text string, source string, _distance double")
    best = ranking.rerank(hits, F.lit(1.0), F.col("source") == "bad", 10).orderBy("out_rank").collect()
    assert [r.in_rank for r in best] == [7, 8, 1, 3] and best[-1].score == pytest.approx(0.001)


def test_context_stops_at_the_first_block_that_does_not_fit(spark):
    hits = spark.createDataFrame([(1, "a" * 50, "s"), (2, "b" * 500, "s"), (3, "c", "s")], "rank int, text string, source string")
    blocks = ranking.context_blocks(hits, budget=100)
    assert [r.n for r in blocks.collect()] == [1]
    assert ranking.context(blocks).first().context == "[1] s\n" + "a" * 50 + "\n"
    assert ranking.context_blocks(hits.where("rank = 2"), budget=100).count() == 0


def test_recursive_chunks(spark):
    para = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8))
    for size, overlap in ((100, 20), (37, 10), (1000, 200)):
        chunks = chunking.split_recursively(para, size, overlap)
        assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
        at = 0
        for w in para.split():
            assert any(w in c for c in chunks[at : at + 4])
            while w not in chunks[at]:
                at += 1
    assert chunking.split_recursively("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.split_recursively("abcdefghijklmno", 10, 3) == ["abcdefghij", "hijklmno"]
    assert chunking.split_recursively("", 10, 3) == [] and chunking.split_recursively(" \n ", 10, 3) == []
    df = spark.createDataFrame([(1, para), (2, None), (3, "")], "id int, text string")
    assert {r.id for r in chunking.recursive_chunks(df).collect()} == {1}


POSITIVE = {
    "eval runs any code": "eval (x)", "exec runs any code": "exec(x)", "dynamic import": "__import__('os')", "unsafe unpickling": "pickle.loads(x)",
    "YAML without a safe loader": "yaml.load(f)", "subprocess through a shell": "subprocess.run(x, shell = True)", "shell injection": "os.system('x')",
    "shell exec in a script": "child_process.exec('x')", "raw HTML in a component": "dangerouslySetInnerHTML", "document.write": "document.write(x)",
    "unsanitised innerHTML": "a.innerHTML = b", "TLS verification off": "verify=False", "TLS verification bypassed": "ssl._create_unverified_context",
    "world-writable mode": "chmod 777", "wide file mode": "0o666", "password in code": "password = 'abc'", "API key in code": "api-key='x'",
    "secret key in code": "SECRET_KEY='x'", "private key": "BEGIN RSA PRIVATE KEY", "possible backdoor": "Backdoor",
    "possible authentication bypass": "skip the auth", "debugging in production": "debug = True # in prod",
}


def test_audit_rules(spark):
    assert set(POSITIVE) == {name for _, name, _ in audit.RULES}
    df = spark.createDataFrame([(k, v) for k, v in POSITIVE.items()], "rule string, text string")
    hit = df.select("rule", F.filter(audit.rule_counts(F.col("text")), lambda x: x["n"] > 0).alias("h")).collect()
    assert all(r.rule in [h.rule for h in r.h] for r in hit)
    for r in hit:
        assert sorted(h.rule for h in r.h) == sorted({f["rule"] for f in audit.findings_in(POSITIVE[r.rule])})


def test_audit_looks_for_what_its_rules_need(spark):
    texts = [v for v in POSITIVE.values()] + [v.upper() for v in POSITIVE.values()] + ["\u017fkip the auth", "bac\u212adoor", "# nur im test, production", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", audit.rule_counts(F.col("text")).alias("c"))
    for r in df.collect():
        text = texts[r.i] or ""
        want = {name: n for p, name, _ in audit.RULES if (n := len(list(re.finditer(p, text, re.IGNORECASE | re.MULTILINE))))}
        found = [f["rule"] for f in audit.findings_in(text)]
        assert {c.rule: c.n for c in r.c if c.n} == {f: found.count(f) for f in found} == want


def test_audit_of_fences_and_report(spark):
    rows = [(1, "```py\nexec(a)\n``` eval(b)"), (2, "```\nfine\n``` eval(b)"), (3, "nothing"), (4, "eval(1) " * 20), (5, None)]
    got = {r.id: r for r in audit.audited(spark.createDataFrame(rows, "id int, text string")).withColumns(
        {"shown": audit.shown_findings(F.col("findings")), "report": audit.report(F.col("findings"))}).collect()}
    assert [f.rule for f in got[1].findings] == ["exec runs any code"] and [f.rule for f in got[2].findings] == ["eval runs any code"]
    assert got[3].findings == [] and got[5].findings == [] and len(got[4].findings) == 20
    keys = []
    for f in got[4].findings[:12]:
        if (k := (f.rule, f.excerpt[:60])) not in keys:
            keys.append(k)
    assert [(f.rule, f.excerpt[:60]) for f in got[4].shown] == keys and got[2].report.startswith("- [CRITICAL] eval runs any code: ")


def test_domains(spark):
    table = domains.domain_table(spark)
    assert [r.id for r in domains.active(table, ["nope"]).collect()] == ["it"]
    assert [r.value for r in domains.merged(domains.active(table, ["it", "law"]), "seeds").collect()] == ["Linux", "Databases", "Networks", "Contracts"]
    assert [r.value for r in domains.merged(domains.active(table, ["universal"]), "seeds", ["x", "y"]).collect()] == ["x", "y"]
    names = F.array(F.lit("Informatics"))
    assert column(spark, [" q ", "informal"], lambda q: domains.enhanced(q, names, F.lit(False))) == ["Informatics: q", "informal"]
    assert column(spark, [" q "], lambda q: domains.enhanced(q, names, F.lit(True))) == ["q"]


def test_prompts(spark):
    assert column(spark, ["a-70B", "b:14b", "c-8b", "d"], prompts.context_window) == [2048, 3072, 4096, 8192]
    fixed = prompts.repair_messages(F.lit("q"), F.lit("a" * 7000), F.lit("- x"))
    made = spark.range(1).select(fixed.alias("m")).first().m
    assert [m.role for m in made] == ["system", "user"] and made[1].content.count("a" * 6000) == 1 and "a" * 6001 not in made[1].content
    sentence = prompts.domain_sentence(F.array(F.lit("A"), F.lit("B")))
    assert spark.range(1).select(sentence).first()[0].endswith("A, B.")


def test_engine_stands_without_the_training_data_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "loamstone")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "loamstone.llm" not in f.read(), n
