import re

import pytest

from lineseek.llm.queries import SITE_RULES
from lineseek.llm.url_rules import DEFAULT_PATTERNS, judge_urls, pattern_rule, site_rule

SCHEMA = "page_id bigint, url string, host string, tokens string, best int, rule string"
SITES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [
    None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://A.Example.ORG/es/x", "https://example.org/es",
    "https://example.org/es/", "https://myexample.org/es/1", "https://x.example.org/en/1", "https://example.org/en/12?q=1",
    "https://example.org/en/2#/en/1", "https://example.org?x=/es/", "ftp://b.com/fr/", "http://b.com/FR/", "http://b.com/de/#x",
    "http://com/de/", "http://b.com:80/de/", "http://b.net/de/", "http://m.ads-track.example.net/x", "http://ads-track.com/fr/1",
    "http://x.net/wp-admin/y", "http://x.net/user/login", "http://x.net/user/logins", "http://ÄB.org/ß/", "a://b://c.org/d",
    "http://x.net/" + "a/" * 20_000, "http://org/\nx", "http://example.org/es/" + "é" * 3000,
]


def brute(url):
    match = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = match.groups() if match else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in SITES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            best = max(best or ("", ""), (rule, verdict), key=lambda x: len(x[0]))
    if best:
        return host, path, *best
    blocked = any(rule.verdict == "block" and re.search(rule.regex, host + path) for rule in DEFAULT_PATTERNS)
    return host, path, None, "block" if blocked else "allow"


@pytest.mark.parametrize("rules", [[*SITE_RULES, *DEFAULT_PATTERNS]])
def test_against_brute_force(spark, rules):
    df = spark.createDataFrame([(i, url, "h", "t", 1, "r") for i, url in enumerate(URLS + URLS)], SCHEMA)
    got = {row.page_id: tuple(row)[1:] for row in judge_urls(df, rules).collect()}
    assert got == {i: brute(url) for i, url in enumerate(URLS + URLS)}


def test_only_the_rarest_token_files_a_rule(spark):
    df = spark.createDataFrame([(i, "http://a.com/common/%s" % ("rare" if i == 0 else "x"), "", "", 1, "") for i in range(5)], SCHEMA)
    judged = judge_urls(df, [pattern_rule("block", "common/rare", "common", "rare")])
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "rare" in plan and "Join" not in plan and "Python" not in plan
    assert {row.page_id for row in judged.collect() if row.verdict == "block"} == {0}


def test_fifty_thousand_rules(spark, rng):
    """Rules of which few are fetched for any URL, some under one common token."""
    rules = [site_rule("block" if i % 2 else "allow", f"host{i}.net/a{i % 7}/") for i in range(49_000)]
    rules += [pattern_rule("block", f"/shared/{i}x$", "shared") for i in range(1000)]
    urls = [f"http://www.host{rng.randrange(60_000)}.net/a{rng.randrange(7)}/p" for _ in range(3000)]
    urls += [f"http://z.org/shared/{i}x" for i in range(990, 1010)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules, default="none").collect()

    def want(url):
        if "shared" in url:
            return "block" if int(url.rsplit("/", 1)[1][:-1]) < 1000 else "none"
        number, folder = map(int, re.search(r"host(\d+)\.net/a(\d)", url).groups())
        return ("block" if number % 2 else "allow") if number < 49_000 and number % 7 == folder else "none"

    assert {row.page_id: row.verdict for row in got} == {i: want(url) for i, url in enumerate(urls)}
    assert {row.verdict for row in got} == {"allow", "block", "none"}


def test_rules_without_tokens_or_rules_at_all(spark):
    df = spark.createDataFrame([(1, "http://a.com/x;y", "", "", 1, "")], SCHEMA)
    assert judge_urls(df, [pattern_rule("block", ";")]).first().verdict == "block"
    assert judge_urls(df, []).first().verdict == "allow"
    assert judge_urls(df.limit(0), SITE_RULES).collect() == []


def test_site_rules_know_their_whole_tokens():
    assert set(site_rule("block", "example.org/en/1").tokens) == {"example", "org", "en"}
    with pytest.raises(ValueError):
        site_rule("block", "example.org")
