import math
import re

import numpy as np

from loamstone.llm import url_filter
from loamstone.llm.queries import URL_RULES

URLS = [
    "http://Example.ORG/es/x", "https://a.example.org/en/1?q", "https://example.org/en/2#t", "http://b.com/fr/", "http://b.com/de", "http://b.com/de/x",
    "http://com/de/", "http://xcom/de/", "ftp://u@b.com:80/p", "nothing", None, "", "http://", "http://h", "http://h?x://y/z", "a://b://c/d", "http://É.org/a",
    "http://1.2.3.4/x", "http://x.co.uk/y", "http://co.uk/y", "http://b.com/" + "p" * 100_000, "http://b.com/a\nb?c", "http://good.net/1", "http://good.net/1",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def tables(spark, outcomes):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, n int")
    return pages, spark.createDataFrame(outcomes, "page_id long, good int")


def test_hosts_paths_and_rules(spark):
    pages, outcomes = tables(spark, [])
    got = {r.page_id: r for r in url_filter.judge_urls(pages, outcomes, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, best = brute(u)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((best[1], best[0]) if best else (None, "allow"))


def test_reputation_shrinks_and_blocks(spark):
    urls = [f"http://bad{i % 3}.evil.net/{i}" for i in range(60)] + [f"http://w{i % 20}.fine.net/{i}" for i in range(400)] + ["http://new.evil.net/", "http://new.fine.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int("fine" in u)) for i, u in enumerate(urls[:460])] + [(3, None), (None, 1)], "page_id long, good int")
    known = {r.host: r for r in url_filter.reputations(pages, outcomes).collect()}
    assert known["bad0.evil.net"].n == 20 and known["bad0.evil.net"].good == 0
    assert known["bad0.evil.net"].upper < 0.5 < known["w1.fine.net"].lower
    assert known["new.evil.net"].n == 0 and known["new.evil.net"].rate < 0.5 < known["new.fine.net"].rate
    for r in known.values():
        assert 0 < r.rate < 1 and math.isfinite(r.lower)
    verdict = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, outcomes, ()).collect()}
    assert verdict[0] == "block" and verdict[100] == "allow" and len(verdict) == len(urls)


def test_domains(spark):
    rows = spark.createDataFrame([(h,) for h in ("a.b.com", "b.com", "com", "x.y.co.uk", "co.uk", "1.2.3.4", "", "a.co.kr", "b.a.com.tr", "x.co.example", "u.github.io")], "h string")
    d, s = url_filter.domain_and_suffix(rows["h"], url_filter.suffix_labels(rows["h"]))
    got = {r.h: (r.d, r.s) for r in rows.select("h", d.alias("d"), s.alias("s")).collect()}
    assert got == {
        "a.b.com": ("b.com", "com"), "b.com": ("b.com", "com"), "com": ("com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"),
        "co.uk": ("co.uk", "uk"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "": ("", ""),
        "a.co.kr": ("a.co.kr", "co.kr"), "b.a.com.tr": ("a.com.tr", "com.tr"), "x.co.example": ("co.example", "example"), "u.github.io": ("github.io", "io"),
    }


def test_empty_table(spark):
    pages, outcomes = tables(spark, [(1, 1)])
    assert url_filter.judge_urls(pages.limit(0), outcomes, URL_RULES).count() == 0


def test_table_of_suffixes(spark):
    urls = [f"http://bad.github.io/{i}" for i in range(30)] + [f"http://good{i % 9}.github.io/{i}" for i in range(90)] + ["http://q.r.city.kobe.jp/", "http://github.io/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i >= 30)) for i in range(120)], "page_id long, good int")
    listed = spark.createDataFrame([("github.io",), ("github.io",), (None,), ("kobe.jp",), ("city.kobe.jp",)], "suffix string")
    hosts = spark.createDataFrame([("bad.github.io",), ("github.io",), ("q.r.city.kobe.jp",), ("x.com",)], "host string")
    assert {tuple(r) for r in url_filter.listed_labels(hosts, listed).collect()} == {("bad.github.io", 2), ("github.io", 2), ("q.r.city.kobe.jp", 3)}
    known = {r.host: r for r in url_filter.reputations(pages, outcomes, suffixes=listed).collect()}
    assert known["bad.github.io"].upper < 0.5 < known["good1.github.io"].lower and len(known) == 13
    assert {r.verdict for r in url_filter.judge_urls(pages, outcomes, (), suffixes=listed.limit(0)).collect()} == {"allow", "block"}


def simpson(a, b, x, n=20_000):
    """The beta distribution function by a plain sum, for a, b >= 1."""
    norm = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    f = lambda t: norm * t ** (a - 1) * (1 - t) ** (b - 1)
    h = x / n
    return h / 3 * (f(0) + f(x) + 4 * sum(f((i + 0.5) * h * 2) for i in range(n // 2)) + 2 * sum(f(i * h * 2) for i in range(1, n // 2)))


def test_posterior_bounds_are_beta_quantiles():
    a, b = np.array([1.0, 1.0, 2.5, 30.0, 400.0, 0.01, 7.0]), np.array([1.0, 9.0, 1.5, 2.0, 350.0, 0.5, 100_000.0])
    for p in (0.05, 0.5, 0.95):
        x = url_filter.beta_quantile(p, a, b)
        assert np.allclose(url_filter.beta_cdf(x, a, b)[[0, 1, 2, 3, 4, 6]], p, atol=1e-8)
        for i in range(5):
            assert abs(simpson(a[i], b[i], x[i]) - p) < 1e-6
        assert abs(x[0] - p) < 1e-9 and abs(x[1] - (1 - (1 - p) ** (1 / 9))) < 1e-9
    # The normal approximation would let such a host pass: mean + 1.645 sd is above a half.
    mean, sd = 0.5 / 3, math.sqrt(0.5 * 2.5 / 9 / 4)
    assert mean + 1.645 * sd > 0.45 and url_filter.beta_quantile(0.95, np.array([0.5]), np.array([2.5]))[0] > 0.5


def test_null_and_repeated_page_ids(spark):
    pages = spark.createDataFrame([(1, "http://a.x/1"), (1, "http://b.x/1"), (None, "http://a.x/2"), (None, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, 0)], "page_id long, good int")
    known = {r.host: (r.n, r.good) for r in url_filter.reputations(pages, outcomes).collect()}
    assert known == {"a.x": (2, 1), "b.x": (2, 1), "": (0, 0)}
    assert url_filter.judge_urls(pages, outcomes, ()).count() == 4


def test_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/d")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    for rules in ((("block", "b.c/"), ("allow", "b.c/")), (("allow", "b.c/"), ("block", "b.c/"))):
        assert url_filter.judge_urls(pages, none, rules).first().verdict == rules[0][0]


def test_suffixes_of_any_length_wildcards_and_exceptions(spark):
    suffixes = ["com", "s3.dualstack.us-east-1.amazonaws.com", "ck", "*.ck", "!www.ck", "*.compute.example.com", "jp", "*.kobe.jp", "!city.kobe.jp"]
    want = {
        "a.b.s3.dualstack.us-east-1.amazonaws.com": 5, "s3.dualstack.us-east-1.amazonaws.com": 5, "dualstack.us-east-1.amazonaws.com": 1,
        "shop.co.ck": 2, "www.ck": 1, "x.www.ck": 1, "ck": 1, "a.b.compute.example.com": 4, "compute.example.com": 1,
        "a.b.kobe.jp": 3, "city.kobe.jp": 2, "x.city.kobe.jp": 2, "kobe.jp": 1, ".".join("a" * 3000) + ".com": 1,
    }
    hosts = spark.createDataFrame([(h,) for h in [*want, "no.such", ""]], "host string")
    found = url_filter.listed_labels(hosts, spark.createDataFrame([(s,) for s in suffixes], "suffix string"))
    assert {r.host: r.listed for r in found.collect()} == want
