"""Rules, link graph and propagation of the url filter, against plain Python."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketlens.llm import linkrank

SCHEMA = "page_id long, url string, html string, host string"


def brute_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in linkrank.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(pages, rounds=linkrank.ROUNDS):
    parts = [brute_parts(u) for _, u, *_ in pages]
    ruled = [brute_rule(*p) for p in parts]
    weight = defaultdict(float)
    hosts = {h for h, _ in parts}
    for (host, _), (_, _, html, *_) in zip(parts, pages):
        for dst in re.findall(linkrank.LINK, html or ""):
            if host and dst.lower() != host:
                weight[host, dst.lower()] += 1
                hosts.add(dst.lower())
    steps = set()
    for host in hosts - {""}:
        chain = host.split(".")
        for i in range(len(chain)):
            parent = ".".join(chain[i + 1:])
            if "." in parent:
                steps |= {(".".join(chain[i:]), parent), (parent, ".".join(chain[i:]))}
    for step in steps:
        weight[step] += 1
    ranks = []
    for want, edges in (("allow", weight), ("block", {(d, s): w for (s, d), w in weight.items()})):
        seed = defaultdict(float)
        for host in hosts - {""}:
            own = [v for (h, _), (_, v) in zip(parts, ruled) if h == host]
            if want in own:
                seed[host] = own.count(want) / len(own)
        total = defaultdict(float)
        for (s, _), w in edges.items():
            total[s] += w
        rank = dict(seed)
        for _ in range(rounds):
            new = defaultdict(float)
            for h, s in seed.items():
                new[h] += 0.15 * s
            for (s, d), w in edges.items():
                if s in rank:
                    new[d] += 0.85 * rank[s] * w / total[s]
            rank = new
        whole = sum(rank.values()) or 1
        ranks.append({h: r / whole for h, r in rank.items()})
    trust, distrust = ranks
    rows = []
    for (page_id, *_), (host, path), (rule, verdict) in zip(pages, parts, ruled):
        t, d = trust.get(host, 0), distrust.get(host, 0)
        own = "block" if t + d and round(d / (t + d), 9) > 0.5 else "allow"
        rows.append((page_id, host, path, rule, verdict or own))
    return sorted(rows, key=str)


def judged(spark, rows, schema=SCHEMA):
    out = linkrank.judge_urls(spark.createDataFrame(rows, schema), linkrank.rule_table(spark))
    return sorted((tuple(r)[:5] for r in out.collect()), key=str)


def test_links_carry_trust_and_distrust(spark):
    def link(*hosts):
        return "".join(f'<a HREF="https://{h}/x">' for h in hosts)

    pages = [
        (1, "http://good.org/fr/a", link("Friend.info", "good.org"), "x"),
        (2, "http://friend.info/a", None, "x"),
        (3, "http://bad.net/a", "", "x"),
        (4, "http://fan.info/b", link("bad.net"), "x"),
        (5, "https://A.Example.net/en/1?q#f", "//ads.info/x src=//cdn.info/y", "x"),
        (6, "https://example.net", None, "x"), (7, "no scheme", None, "x"),
        (8, None, None, None), (8, None, None, None),
        (9, "x://u.EXAMPLE.com/de/", link("fan.info"), "x"),
        (10, "http://lone.info/", None, "x"),
    ]
    rows = judged(spark, pages)
    assert rows == brute(pages)
    verdicts = {r[0]: r[4] for r in rows}
    assert verdicts == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow",
                        7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert len(rows) == len(pages)


def test_longest_rule_and_large_rule_table(spark):
    rules = [("t", f"/{i}/", "allow") for i in range(300)] + [("t", "/", "block")]
    table = spark.createDataFrame(rules, "h string, p string, v string")
    pages = spark.createDataFrame(
        [(i, f"http://s{i % 3}.t/{i}/", "") for i in range(0, 600, 60)],
        "page_id long, url string, html string")
    rows = linkrank.judge_urls(pages, table).collect()
    assert {r["page_id"]: r["rule"] for r in rows} == {
        i: f"t/{i}/" if i < 300 else "t/" for i in range(0, 600, 60)}


def test_empty(spark):
    assert judged(spark, []) == []


@pytest.mark.parametrize("key", ["whole table"])
def test_query(spark, sf_dir, key):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = linkrank.op10_urls(spark, sf_dir)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(pages)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.where(F.col("verdict").isNull()).count() == 0
