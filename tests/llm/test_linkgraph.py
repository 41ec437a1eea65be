import random
import re
from collections import defaultdict

import duckdb

from logweave.llm import linkgraph, queries

RULES = queries.URL_RULES


def pages(spark, rows):
    """(page_id, url, html) plus columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "page_id long, url string, html string, host string, rule string, mass long, trust long")


def brute(rows, rules=RULES, steps=40, threshold=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    judged, edges = [], set()
    seeds = {"trust": defaultdict(int), "distrust": defaultdict(int)}
    for page, url, html in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(lower), m[2]) if m else ("", "")
        fits = [(-len(h + p), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        rule, verdict = min(fits)[1:] if fits else (None, None)
        if verdict:
            seeds["trust" if verdict == "allow" else "distrust"][host] += 10**6
        judged.append((page, host, path, rule, verdict))
        for to in re.findall(linkgraph.LINK, html or ""):
            if host and to.translate(lower) != host:
                edges.add((host, to.translate(lower)))
    score = {}
    for kind, front in seeds.items():
        out = defaultdict(list)
        for a, b in edges:
            out[a if kind == "trust" else b].append(b if kind == "trust" else a)
        total = defaultdict(int, front)
        for _ in range(steps):
            moved = defaultdict(int)
            for h, m in front.items():
                for to in out[h]:
                    moved[to] += m * 85 // (100 * len(out[h]))
            front = {h: m for h, m in moved.items() if m}
            for h, m in front.items():
                total[h] += m
        score[kind] = total
    res = []
    for page, host, path, rule, verdict in judged:
        t, d = score["trust"].get(host, 0), score["distrust"].get(host, 0)
        res.append((page, host, path, rule, verdict or ("block" if d * 100 > threshold * (t + d) else "allow"), t, d))
    return sorted(map(repr, res))


def result(spark, rows, **kw):
    df = linkgraph.judge(pages(spark, rows), linkgraph.rule_table(spark, RULES), **kw)
    return sorted(repr(tuple(r)) for r in df.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect())


def web(rng, n, hosts):
    rows = []
    for page in range(n):
        host = hosts[0] if page % 3 == 0 else rng.choice(hosts)
        lang = rng.choice(["/fr/", "/de/", "/es/", "/en/1", "/en/2", "", "/"])
        links = "".join(rng.choice([f'<a href="https://{h}/x">', f"<a  href='//{h.upper()}'>", f'<a href="/local">{h}</a>', f"<a href=http://{h}?q>"]) for h in rng.sample(hosts, 2))
        rows.append((page, f"https://{host}{lang}{rng.choice(['', '?a=b', '#top'])}", f"<html>{links}</html>"))
    return rows


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.example.{t}" for i in range(6) for t in ("net", "com", "org")]
    rows = web(rng, 150, hosts)
    want = brute(rows)
    assert any("None, 'block'" in r for r in want) and any("None, 'allow'" in r for r in want)
    assert result(spark, rows) == want


def test_verdicts_equal_sql(spark):
    rng = random.Random(8)
    rows = web(rng, 120, [f"a{i}.example.{t}" for i in range(5) for t in ("net", "com")])
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    got = con.execute(f"select page_id, host, path, rule, verdict, trust, distrust from ({queries.OP13})").fetchall()
    assert sorted(map(repr, got)) == result(spark, rows) == brute(rows)


def test_nulls_repeats_and_odd_urls(spark):
    rows = [
        (1, None, None), (1, None, None), (2, "no scheme", "<a href='http://x.com/'>"), (None, "HTTP://WWW.Example.ORG/es/1?x://y", None), (3, "a://b.org", ""),
        (4, "x://org/", None), (5, "x://notorg/", None), (6, "x://.com/de/", None), (7, "x:///de/", None), (8, "x://u@h.com:80/de/", None),
        (9, "x\ny://example.org/en/1\n2", None), (10, "x://" + "a." * 5000 + "com/fr/" + "p" * 100_000, "z " * 50_000), (11, "x://ÄÖ.com/fr/", "<a href=//ÄÖ.net>"),
    ]
    assert result(spark, rows) == brute(rows)


def test_hub_with_many_links_is_dealt_into_slots(spark, monkeypatch):
    monkeypatch.setattr(linkgraph, "SLOT_EDGES", 7)
    links = "".join(f'<a href="https://s{i}.net/">' for i in range(100))
    rows = [(1, "https://hub.com/fr/", links), (2, "https://bad.com/de/", None), (3, "https://s1.net/", '<a href="https://bad.com/"> <a href="https://s2.net">')]
    rows += [(10 + i, f"https://s{i}.net/q", None) for i in range(100)]
    want = brute(rows)
    assert result(spark, rows) == want and len({r.split("(")[1].split(",")[4] for r in want}) == 2


def test_tie_and_threshold(spark):
    rows = [(1, "https://a.com/fr/", None), (2, "https://a.com/de/", None), (3, "https://a.com/xx/", None), (4, "https://a.com/de/", None)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows[:3]) == brute(rows[:3])
    assert result(spark, rows, threshold=80) == brute(rows, threshold=80)


def test_no_pages_and_no_rules(spark):
    empty = pages(spark, [])
    assert linkgraph.judge(empty, linkgraph.rule_table(spark, RULES)).count() == 0
    none = linkgraph.rule_table(spark, RULES).limit(0)
    got = linkgraph.judge(pages(spark, [(1, "https://a.com/de/", None)]), none).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, "allow")]
