from faultlens.llm.url_filter import RULES, judge_urls


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


URLS = [
    None, "", "example.net/en/x", "http://example.net", "http://example.net/", "http://EXAMPLE.NET/en/1?x#y", "https://a.b.example.com/de/", "https://notexample.com/de/1",
    "https://x.org/fr/", "https://org/fr/2", "https://x.org/FR/", "http://a.net?q=/en/", "http://a.net#/en/", "http://É.example.net/en/é", "x://http://b.net/", "http:///path",
    "http://" + "a." * 200 + "net/" + "p" * 5000, "http://example.net/en", "http://dup.net/", "http://dup.net/"]


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "mine", 7) for i, u in enumerate(URLS)], "page_id long, url string, verdict string, extra int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(url), url
        assert got[i].extra == 7


def test_many_rules_ties_and_empty_tables(spark):
    rows = [(f"h{i}.net", f"/{'d' * (i % 7)}", "block") for i in range(3000)] + [("same.org", "/", "allow"), ("same.org", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("nopath.de", None, "block")]
    rules = spark.createDataFrame(rows, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"https://www.h{i}.net/{'d' * (i % 9)}") for i in range(0, 6000, 7)] + [(-1, "http://same.org/x"), (-2, "http://nopath.de")], "page_id long, url string")
    listed = {(h, p) for h, p, _ in rows}
    for r in judge_urls(pages, rules).collect():
        if r.page_id >= 0:
            want = (f"h{r.page_id}.net", f"/{'d' * (r.page_id % 7)}") in listed and ("d" * (r.page_id % 9)).startswith("d" * (r.page_id % 7))
            assert (r.verdict == "block") == want, r
        else:
            assert r.verdict == "block"
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "u", "s", "k", "b", 5, "h", "p")], "page_id long, url string, _url string, _salt string, k0 string, best string, block int, host string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    row = judge_urls(pages, rules).first().asDict()
    assert row == {"page_id": 1, "url": "http://a.net/x", "_url": "u", "_salt": "s", "k0": "k", "best": "b", "block": 5, "host": "a.net", "path": "/x", "rule": "net/", "verdict": "block"}
