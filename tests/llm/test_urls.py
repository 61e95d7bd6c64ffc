"""URL rules against a plain comparison of every rule with every url."""

import random

import numpy as np

from loam.llm import urls

SCHEMA = "verdict string, host string, path string"


def plain(rules, url):
    host, path = "", ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(len(h) + len(p), v == "block", h + p, v) for v, h, p in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_against_plain(spark):
    rng = random.Random(2)
    rules = urls.RULES + [("block", "a.b.net", ""), ("allow", "b.net", "/x"), ("block", "b.net", "/x"), ("allow", "net", "/x/y")]
    hosts = ["example.org", "EN.example.org", "org", "x.com", "com", "a.b.net", "z.a.b.net", "b.net", "ab.net", "é.org", ""]
    paths = ["", "/", "/es/", "/en/1", "/en/123", "/fr/1", "/de/", "/x", "/x/y", "/X", "/日本/"]
    many = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#top', '/more'])}"
            for _ in range(600)]
    many += [None, "", "no scheme", "://", "http://", "a://b://c/de/", "http://x.com?/de/", "http://x.com#/de/", "http://" + "a." * 3000 + "org/"]
    df = spark.createDataFrame([(i, u, "html", "r") for i, u in enumerate(many)], "page_id int, url string, html string, rule string")
    out = urls.filter_urls(df.repartition(3), spark.createDataFrame(rules, SCHEMA)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: plain(rules, u) for i, u in enumerate(many)}
    assert urls.filter_urls(df.limit(0), spark.createDataFrame(rules, SCHEMA)).count() == 0
    free = urls.filter_urls(df, spark.createDataFrame([], SCHEMA)).where("verdict = 'allow' and rule is null")
    assert free.count() == len(many)


def test_equal_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "rule_keys", lambda texts: np.zeros(len(texts), np.uint64))
    (tmp_path / "f").write_bytes(urls.build_file([("block", h, p) for h in ("a.org", "b.org") for p in ("/", "/x", "/yy")]))
    rules = urls.RuleFile(str(tmp_path / "f"))
    got = urls.judge([rules], ["u://a.org/x", "u://b.org/yy/", "u://c.org/", "u://w.b.org/z"])
    assert [g[2] for g in got] == ["a.org/x", "b.org/yy", None, "b.org/"]


def test_long_lists_become_several_files(spark):
    rules = [("block" if i % 2 else "allow", f"H{i}.org", f"/{'x' * (i % 5)}") for i in range(40)] + [("block", "h3.ORG", "/xxx")]
    df = spark.createDataFrame(rules, SCHEMA)
    assert len(urls.ship_rules(spark, df, 1 << 20)) == 1 and len(urls.ship_rules(spark, df, 400)) > 3
    names = urls.ship_rules(spark, df, 400)
    files = [urls.RuleFile(urls.SparkFiles.get(n)) for n in names]
    many = [f"u://a.h{i}.org/{'x' * k}" for i in range(41) for k in range(6)]
    lowered = [(v, h.lower(), p) for v, h, p in rules]
    assert urls.judge(files, many) == [plain(lowered, u) for u in many]
