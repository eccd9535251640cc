import random

import pytest

from branchwise.llm import url_filter as U


def brute(url, rules, default="allow"):
    i = (url or "").find("://")
    rest = url[i + 3:] if url and i >= 0 else ""
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[:min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    best = None
    for verdict, h, p in rules:
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p) and (host or not h):
            key = (h.count(".") + bool(h), len(p), verdict == "block")
            best = max(best or (key,), (key, h + p, verdict))
    return host, path, *(best[1:] if best else (None, default))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rules = [(rnd.choice(["allow", "block"]), ".".join(rnd.choices(["a", "b", "net"], k=rnd.randint(1, 3))),
              rnd.choice(["", "/", "/x", "/x/", "/x/y", "/xy/z/", "/x//"])) for _ in range(25)]
    urls = [rnd.choice(["http", "HTTPS"]) + "://" + ".".join(rnd.choices(["a", "B", "net", "", "b"], k=rnd.randint(1, 4)))
            + rnd.choice(["", "/", "/x", "/x/y/z", "/xy", "/x//y", "/xy/z/1", "/xyz"]) + rnd.choice(["", "?q=/x/", "#t"])
            for _ in range(400)] + [None, "", "no scheme/x", "://", "a://b://c/x", "x://A.NET/" + "y/" * 20000]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_tables_rules_and_bound(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, U.RULES).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert U.filter_urls(df, U.RULES).count() == 0
    one = spark.createDataFrame([(None, "http://a.net/x"), (None, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(one, [], default="block").collect()] == ["block"] * 2


def test_long_segments_and_bound(spark, monkeypatch):
    rules = [("block", "a.net", "/x"), ("allow", "a.net", "/xyz"), ("block", "a.net", "/" + "q" * 999_999)]
    urls = ["http://a.net/x" + "y" * 1_000_000, "http://a.net/xyz" + "z" * 1_000_000, "http://a.net/" + "q" * 1_000_000, "http://" + "b." * 500_000 + "a.net/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(df, rules).orderBy("page_id").collect()] == ["block", "allow", "block", "block"]
    monkeypatch.setattr(U, "MAX_NODES", 3)
    with pytest.raises(ValueError):
        U.filter_urls(df, rules)


def test_block_beats_equal_allow():
    trie = U.build_trie([("block", "a.b", "/"), ("allow", "a.b", "/"), ("allow", "", "/z")])
    assert U.lookup(trie, "c.a.b", "/z") == ("a.b/", "block") and U.lookup(trie, "", "/zz") == ("/z", "allow")
