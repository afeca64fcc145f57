import random
import re

from kinsift.llm import url_filter as U


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else default


def found(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def test_edge_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.Example.NET/en/", "http://example.net/en", "http://notexample.net/en/x", "http://example.com/de/1?x#y", "http://example.com?/de/", "a://b.org/fr/#", "x://y://org/fr/", "http://example.com#/de/", "http://b.org/fr", "http://É.net/é\n/x", "http://.net/", "http://net./", "http://u:p@x.net:80/en/", "http://x.net/" + "a/" * 20_000, "http://x.net/", "http://x.net/"]
    pages = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, host int")
    assert found(U.judge(pages)) == sorted(((i, *plain(u, U.RULES)) for i, u in enumerate(urls)), key=str)
    assert U.judge(pages.filter("false")).collect() == []


def test_random_rules_in_one_trie_and_in_many(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "com"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice(["x", "y/", "xx/", "/"]) for _ in range(rng.randrange(0, 4)))
    rules = {(r.host, r.path): r for r in (U.Rule(host(), path(), rng.choice(["allow", "block"])) for _ in range(80))}.values()
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(((i, *plain(u, rules)) for i, u in enumerate(urls)), key=str)
    assert found(U.judge(pages, rules)) == want
    assert found(U.judge(pages, rules, max_bytes=60)) == want
