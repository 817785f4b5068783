"""URL filter: explicit rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain
and suffix. Each level's rate is shrunk towards its parent's with a
beta-binomial prior: suffixes towards the overall rate, domains towards their
suffix, hosts towards their domain. How strongly is estimated from the counts
themselves, by the method of moments, once for each level. A host is blocked
if even the upper bound of its posterior good rate, a quantile of its beta posterior, stays below a threshold, so
a host with few or no outcomes is judged by its domain and suffix.

A suffix is that of a table of public suffixes, where one is given, the longest that fits, of any number of labels; the table's rules are
names, `*.name` for every name one label longer, and `!name` for one that is no suffix in spite of such a rule. Otherwise it is the last
label, or the last two where a country's two letters follow a label that registries use for kinds of names.

Counts are partial aggregates; the join back to the pages is a plain equi-join
on the host that can be split where a host is hot. Nothing grows on the
driver: it sees three pairs of sums.

Defined results:
 - null url or one without `://`: host and path empty, no rule; all such pages form one host, the empty one;
 - userinfo and port belong to the host that is returned, and not to the one whose reputation is taken;
 - null outcomes do not count; several outcomes of a page each count;
 - null or repeated page_id: each row is judged by its url; outcomes join on equal, non-null ids;
 - very long urls: whole; rules of equal length: the first one listed; no outcomes at all: every host is allowed;
 - a host that is a suffix is its own domain; null or repeated suffixes in the table: as if they were not there;
 - an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import materialise

#: Labels under which registries of countries give names out, as in co.uk or com.br.
KINDS_OF_NAMES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest of the (action, host/path) rules that fits; a short list of fixed rules."""
    rule = action = F.lit(None).cast("string")
    for verdict, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^[\s\S]*@", ""), r":\d*$", "")


def suffix_labels(host: Column) -> Column:
    """How many labels of a host are its suffix, by the rule for countries."""
    labels = F.split(host, r"\.")
    wide = (F.size(labels) > 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, F.size(labels) - 2).isin(*KINDS_OF_NAMES)
    return F.when(wide, 2).otherwise(1)


def domain_and_suffix(host: Column, labels: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix, which has so many labels; an address is its own."""
    parts = F.split(host, r"\.")
    address = host.rlike(r"^[0-9.]+$|^\[")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return F.when(address, host).otherwise(last(labels + 1)), F.when(address, host).otherwise(last(labels))


def listed_labels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host), suffixes (suffix) -> host, listed: the labels of the longest suffix listed; hosts without one have no row."""
    known = suffixes.where(F.col("suffix").isNotNull()).select(F.col("suffix").alias("_s")).distinct()
    longest = known.agg(F.coalesce(F.max(F.size(F.split("_s", r"\."))), F.lit(1))).first()[0]
    parts = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    rule = lambda n, suffix, barred: F.struct(n.alias("n"), suffix.alias("suffix"), F.lit(barred).alias("barred"))
    rules = lambda n: F.array(
        rule(n, last(n), False), rule(n, F.when(n > 1, F.concat(F.lit("*."), last(n - 1))), False), rule(n - 1, F.concat(F.lit("!"), last(n)), True)
    )
    each = hosts.select("host", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(longest))), rules))))
    fits = each.join(known, F.col("suffix") == F.col("_s"), "left_semi").groupBy("host")
    return fits.agg(F.greatest(F.coalesce(F.max(F.when(F.col("barred"), F.col("n"))), F.max("n")), F.lit(1)).alias("listed"))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(X <= x) for beta(a, b), by its continued fraction (the modified Lentz method)."""
    x, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)  # it converges fast below the mean
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    out, at = np.ones(len(x)), np.arange(len(x))
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones(len(x)), 1 / tiny(1 - (a + b) * x / (a + 1))
    f, m = d.copy(), 0
    while len(at):
        m += 1
        p, q, z = a[at], b[at], x[at]
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            c, d = tiny(1 + term / c), 1 / tiny(1 + term * d)
            f = f * c * d
        done = np.abs(c * d - 1) < 1e-14
        out[at[done]] = f[done]
        at, c, d, f = at[~done], c[~done], d[~done], f[~done]
    out = np.clip(front * out, 0, 1)
    return np.where(swap, 1 - out, out)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x with P(X <= x) = p, by bisection."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50 if len(a) else 0):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def posteriors(hosts: DataFrame, confidence: float) -> DataFrame:
    """host, n, good, a, b -> host, n, good, rate, lower, upper: the mean and both quantiles of beta(a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i)) for i in (3, 4))
            bounds = [pa.array(beta_quantile(p, a, b)) for p in (1 - confidence, confidence)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(a / (a + b)), *bounds], ["host", "n", "good", "rate", "lower", "upper"])

    return hosts.select("host", "n", "good", "a", "b").mapInArrow(run, "host string, n long, good long, rate double, lower double, upper double")


def prior_strength(level: DataFrame) -> float:
    """The pseudo-count of a level's beta prior by the method of moments; rows n, good and mean, the parent's rate."""
    n, k, m = F.col("n"), F.col("good"), F.col("mean")
    spread = (k - n * m) * (k - n * m) - n * m * (1 - m)
    row = level.where("n > 0").agg(F.sum(spread).alias("x"), F.sum(n * (n - 1) * m * (1 - m)).alias("y")).first()
    rho = row["x"] / row["y"] if row["y"] else 0.5
    return 1 / min(max(rho, 1e-3), 0.999) - 1


def reputations(
    pages: DataFrame, outcomes: DataFrame, *, confidence: float = 0.95, suffixes: DataFrame | None = None
) -> DataFrame:
    """pages (page_id, url, ...), outcomes (page_id, good), suffixes (suffix) -> bare host, n, good, rate, lower, upper; a row for each host."""
    host = bare_host(host_of(F.col("url")))
    hosts = pages.select("page_id", host.alias("host"))
    good = outcomes.where(F.col("good").isNotNull()).select(F.col("page_id").alias("p"), F.col("good").cast("long").alias("y"))
    per = hosts.join(good, F.col("page_id") == F.col("p"), "left")
    per = per.groupBy("host").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good"))
    labels = suffix_labels(F.col("host"))
    if suffixes is not None:
        per = materialise(per, "counted")
        listed = listed_labels(per.select("host"), suffixes).withColumnRenamed("host", "of_host")
        per = per.join(listed, F.col("host") == F.col("of_host"), "left")
        labels = F.coalesce("listed", labels)
    domain, suffix = domain_and_suffix(F.col("host"), labels)
    per = materialise(per.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good"), "hosts")

    total = per.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(level: DataFrame, name: str) -> DataFrame:
        strength = prior_strength(level)
        rate = (F.col("good") + strength * F.col("mean")) / (F.col("n") + strength)
        return level.select(F.col(name).alias(f"of_{name}"), rate.alias("mean"))

    def level(*names: str) -> DataFrame:
        return per.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    by_suffix = shrunk(level("suffix").withColumn("mean", F.lit(overall)), "suffix")
    by_domain = level("domain", "suffix").join(by_suffix, F.col("suffix") == F.col("of_suffix"))
    by_domain = shrunk(by_domain, "domain")
    by_host = materialise(per.join(by_domain, F.col("domain") == F.col("of_domain")), "by_host")
    strength = prior_strength(by_host)
    a = F.col("good") + strength * F.col("mean")
    b = F.col("n") - F.col("good") + strength * (1 - F.col("mean"))
    return posteriors(by_host.select("host", "n", "good", a.alias("a"), b.alias("b")), confidence)


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], *, least_good: float = 0.5, **params
) -> DataFrame:
    """pages -> page_id, host, path, rule, verdict and the host's counts and posterior; one row for each row of pages."""
    known = materialise(reputations(pages, outcomes, **params), "reputations").withColumnRenamed("host", "known")
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    joined = parsed.withColumn("bare", bare_host(F.col("host"))).join(known, F.col("bare") == F.col("known"), "left")
    return joined.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_method).alias("verdict"),
        "n", "good", "rate", "lower", "upper",
    )
