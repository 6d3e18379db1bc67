import random
import re

from vectables.llm import urlrules

ROWS = [(1, "http://Example.ORG/es/a"), (2, "https://blog.example.org/en/17?x#y"), (3, "http://notexample.org/es/"), (4, None), (5, "example.org/es/"),
        (6, "http://example.org"), (7, "http://example.org?/es/"), (8, "http://a.com/fr/x"), (9, "http://com/de/"), (10, "://org/"), (None, "http://b.com/de/z"),
        (1, "http://Example.ORG/es/a"), (11, ""), (12, "http:///es/"), (13, "http://x.org/http://y.com/de/"), (14, "http://org/\n/x"), (15, "http://é.example.org/es/" + "q" * 50_000)]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def check(spark, rows, rules, parts):
    urls = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in rows], "page_id long, url string, host string, path string, part int")
    got = urlrules.judge(urls, urlrules.rule_table(spark, rules), "page_id", "url", parts=parts).collect()
    want = sorted(str((i, *brute(u, rules))) for i, u in rows)
    assert sorted(str(tuple(r)) for r in got) == want


def test_contract_rules(spark):
    for parts in (1, 7):
        check(spark, ROWS, RULES, parts)


def test_random_nested_rules_and_a_hot_host(spark):
    rng = random.Random(9)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    rows = [(i, f"http://{'a.b' if i % 3 == 0 else host()}{path()}") for i in range(900)] + [(5000 + i, "http://a.b/x") for i in range(300)]
    check(spark, rows, rules, 13)


def test_no_rules_and_no_urls(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge(urls, urlrules.rule_table(spark, RULES), "page_id", "url").collect() == []
    none = spark.createDataFrame([(None, "/", "block"), ("org", None, "block")], urlrules.RULES)
    urls = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in urlrules.judge(urls, none, "page_id", "url").collect()] == [(1, "a.org", "/", None, "allow")]
