"""Static audit of answers by patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.functions.text import contains_any
from loamstone.schema import FINDING

#: The patterns, each with our name for it and its severity.
RULES = (
    (r"\beval\s*\(", "eval runs any code", "critical"),
    (r"\bexec\s*\(", "exec runs any code", "critical"),
    (r"__import__\s*\(", "dynamic import", "high"),
    (r"pickle\.loads?\s*\(", "unsafe unpickling", "high"),
    (r"yaml\.load\s*\([^)]*\)", "YAML without a safe loader", "high"),
    (r"subprocess\.[a-z]+\([^)]*shell\s*=\s*True", "subprocess through a shell", "high"),
    (r"os\.system\s*\(", "shell injection", "high"),
    (r"child_process\.exec\s*\(", "shell exec in a script", "critical"),
    (r"dangerouslySetInnerHTML", "raw HTML in a component", "high"),
    (r"document\.write\s*\(", "document.write", "high"),
    (r"innerHTML\s*=", "unsanitised innerHTML", "high"),
    (r"verify\s*=\s*False", "TLS verification off", "high"),
    (r"ssl\._create_unverified_context", "TLS verification bypassed", "high"),
    (r"chmod\s+777", "world-writable mode", "high"),
    (r"0o777|0o666", "wide file mode", "high"),
    (r"password\s*=\s*['\"][^'\"]{3,}['\"]", "password in code", "high"),
    (r"api[_-]?key\s*=\s*['\"][^'\"]+['\"]", "API key in code", "high"),
    (r"secret[_-]?key\s*=\s*['\"][^'\"]+['\"]", "secret key in code", "high"),
    (r"BEGIN (RSA |OPENSSH )?PRIVATE KEY", "private key", "high"),
    (r"backdoor", "possible backdoor", "critical"),
    (r"disable.*auth|auth.*bypass|skip.*auth", "possible authentication bypass", "high"),
    (r"debug\s*=\s*True.*#.*prod|#.*nur.*test.*production", "debugging in production", "high"),
)
#: What a text holds, lower-cased, wherever the rule of the same place fits; looked for before the pattern is tried.
NEEDED = (
    ("eval",), ("exec",), ("__import__",), ("pickle.load",), ("yaml.load",), ("subprocess.",), ("os.system",), ("child_process.exec",),
    ("dangerouslysetinnerhtml",), ("document.write",), ("innerhtml",), ("verify",), ("ssl._create_unverified_context",), ("chmod",),
    ("0o777", "0o666"), ("password",), ("api",), ("secret",), ("private key",), ("backdoor",), ("auth",), ("debug", "nur"),
)
#: Characters that stand for ASCII letters when case is ignored, though they do not lower-case to them.
ODD_CASE = "\u017f\u212a\u0130\u0131"
MARGIN, MOST_FINDINGS, KEY_CHARS, SHOWN_CHARS = 40, 12, 60, 120


def rule_counts(text: Column) -> Column:
    """An array of (rule, severity, n): how often each rule fits, inside the JVM; null for a null text."""

    def count(x: Column, pattern: str, needed: tuple[str, ...]) -> Column:
        found = F.regexp_count(x["text"], F.lit(f"(?imdU){pattern}"))
        return F.when(contains_any(x["low"], needed) | x["odd"], found).when(x["text"].isNotNull(), F.lit(0))

    def counts(x: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), count(x, p, needed).alias("n"))
                for (p, name, severity), needed in zip(RULES, NEEDED, strict=True)
            ]
        )

    # Bound in an array of one, so that nothing is computed once for each rule.
    bound = F.struct(text.alias("text"), F.lower(text).alias("low"), contains_any(text, ODD_CASE).alias("odd"))
    return F.element_at(F.transform(F.array(bound), counts), 1)


def findings_in(text: str) -> list[dict]:
    out, low = [], text.lower()
    odd = any(c in text for c in ODD_CASE)
    for (pattern, name, severity), needed in zip(RULES, NEEDED, strict=True):
        if not odd and not any(n in low for n in needed):
            continue
        for m in re.finditer(pattern, text, re.IGNORECASE | re.MULTILINE):
            around = text[max(0, m.start() - MARGIN) : m.end() + MARGIN].replace("\n", " ")
            out.append({"severity": severity, "rule": name, "excerpt": around})
    return out


_FENCE = re.compile(r"```[A-Za-z0-9_]*\n(.*?)```", re.DOTALL)
#: Texts that are Python strings at once.
SLICE = 64


@F.arrow_udf(T.ArrayType(FINDING))
def text_findings(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """All matches in the code fences of a text, or in the whole of it if these yield none, with their surroundings, which may overlap
    (Arrow UDF: built-ins give no places). Of a batch only a slice is decoded at a time."""
    kind = pa.list_(pa.struct([(f.name, pa.string()) for f in FINDING.fields]))

    def found(text: str | None) -> list[dict]:
        fenced = [f for t in _FENCE.findall(text or "") if t for f in findings_in(t)]
        return fenced or (findings_in(text) if text else [])

    for part in texts:
        slices = [pa.array([found(t) for t in part.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(part), SLICE)]
        yield pa.concat_arrays(slices) if slices else pa.array([], kind)


def fences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1))


def audited(answers: DataFrame) -> DataFrame:
    """answers (text, ...) with findings: those in code fences, or in the whole text if the fences yield none."""
    # Only texts that some rule fits reach Python; the others send it nulls.
    suspicious = F.coalesce(F.exists(rule_counts(F.col("text")), lambda x: x["n"] > 0), F.lit(False))
    # Not deterministic as far as the optimizer knows, so that a filter on the findings does not find them once more.
    return answers.withColumn("findings", text_findings.asNondeterministic()(F.when(suspicious, F.col("text"))))


def shown_findings(findings: Column) -> Column:
    """Of the first 12, those whose (rule, start of the excerpt) is new, in order; cut first, then made distinct."""
    first = F.slice(findings, 1, MOST_FINDINGS)

    def fresh(x: Column, i: Column) -> Column:
        earlier = F.slice(first, 1, i)
        same = lambda y: (y["rule"] == x["rule"]) & (F.substring(y["excerpt"], 1, KEY_CHARS) == F.substring(x["excerpt"], 1, KEY_CHARS))
        return ~F.exists(earlier, same)

    return F.filter(first, fresh)


def report(findings: Column) -> Column:
    line = lambda x: F.concat(F.lit("- ["), F.upper(x["severity"]), F.lit("] "), x["rule"], F.lit(": "), F.substring(x["excerpt"], 1, SHOWN_CHARS))
    return F.array_join(F.transform(shown_findings(findings), line), "\n")
