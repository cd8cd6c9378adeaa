import random
import re

from driftmap.llm import registry, url_filter


def judge(url, rules, default="allow"):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url, re.S) if url else None
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, default)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    names = lambda: ".".join(rng.choice(["a", "b", "com", "ab"]) for _ in range(rng.randint(1, 4)))
    paths = lambda: "".join(rng.choice(["/", "x", "/x", "/y/"]) for _ in range(rng.randint(0, 4)))
    known = {}
    for _ in range(60):
        known.setdefault((names(), paths()), rng.choice(["allow", "block"]))
    rules = [(v, h, p) for (h, p), v in known.items()]
    lengths = [len(h + p) for _, h, p in rules]
    urls = [f"http{rng.choice(['', 's'])}://{names().upper()}{paths()}{rng.choice(['', '?q=/x', '#f'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "http://", "x://a.com://b", "http://a.com:80/x", "http://É.a.com/x", "http://a.com/" + "x" * 20000]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(None, urls[0], ""), (0, urls[0], "")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules, rows=7).collect()
    want = sorted([(str(i), *judge(u, rules)) for i, u, _ in rows], key=str)
    have = sorted([(str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got], key=str)
    assert have == want


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, [], "block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_filter.judge_urls(pages.where("false"), [("block", "com", "/")]).count() == 0


def test_rules_of_the_contract(spark, tmp_path):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{v} {h}{p}" for v, h, p in registry.RULES] == contract.split(", ")
    urls = ["a.com/en/1", "x.example.com/en/70", "a.net/de/8", "net/de/", "x.example.net/de/7", "example.net/de/81", "org/es/", "a.org/en/"]
    spark.createDataFrame([(k, f"http://{u}") for k, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.rule, r.verdict) for r in registry.urls(spark, str(tmp_path)).collect()}
    fits = [("com/en/", "block"), ("example.com/en/7", "allow"), *[("net/de/", "allow")] * 3, ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
    assert found == dict(enumerate(fits))
