import pytest

from ridelens.llm.url_rules import PLACE_RULES, Rule, RuleIndex, host_and_path, judge_urls, place_rule

URLS = [
    "https://EXAMPLE.org/es/1", "http://www.example.org/en/123?x=/es/", "http://example.org/en/2",
    "http://notexample.org/es/", "http://a.com/de/", "http://a.com/fr/x#y", "http://com/de/1",
    "http://a.com", "http://org", "http://org/", "no scheme", "", None, "x://a.org?b://c.com/de/",
    "http://a.org:80/", "http://casino-win.net/en", "http://my-casinos.net/", "http://ads-track.net#top",
    "://example.org/en/1", "http://a.com/de", "http://ÄB.org/", "http://a.org\n/es/", "http://a.org\n/es/",
]


def brute(url):
    host, path = host_and_path(url)
    best = None
    for r in PLACE_RULES:
        h, slash, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def test_against_all_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "y")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[r.page_id or 0]
        assert (r.host, r.path) == host_and_path(url)
        best = brute(url)
        assert r.rule == (best and best.name)
        if best:
            assert r.verdict == best.verdict
        else:
            assert (r.verdict == "block") == any(w in (url or "") for w in ("casino-", "ads-track"))


@pytest.mark.parametrize("url, want", [("http://A.B/c?d", ("a.b", "/c")), ("a://b#c/d", ("b", "")), ("a/b", ("", ""))])
def test_parts(url, want):
    assert host_and_path(url) == want


def test_only_candidates_run():
    rules = [place_rule(f"host{i}.net/", "block") for i in range(1000)] + [Rule("any", "block", "zzz", ())]
    index = RuleIndex(rules, {"net": 10**6})
    names = [r.name for r, _ in index.candidates("www.host7.net/x")]
    assert sorted(names) == ["any", "host7.net/"]
    assert index.best("www.host7.net", "/x").name == "host7.net/"


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
