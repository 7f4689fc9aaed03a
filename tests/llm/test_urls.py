from collections import defaultdict

import pytest

from masterloom.llm.common import table
from masterloom.llm.query_urls import RULES, op10_url_trust
from masterloom.llm.urls import judge_urls

from .helpers import SF, frame

SCHEMA = "page_id long, url string, html string, verdict string, trust double"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[n:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    return host, tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def expected(pages, links, damping=0.85, rounds=20):
    good, bad = defaultdict(float), defaultdict(float)
    for url in pages:
        host, path = parts(url)
        rule = rule_of(host, path)
        if host and rule:
            (good if rule.allow else bad)[host] += 1
    hosts = {parts(u)[0] for u in pages} | {x for e in links for x in e}

    def flow(seed, edges):
        out = defaultdict(int)
        for a, _ in edges:
            out[a] += 1
        score = dict(seed)
        for _ in range(rounds):
            score = {h: (1 - damping) * seed.get(h, 0) + damping * sum(
                score.get(a, 0) / out[a] for a, b in edges if b == h) for h in hosts}
        return score

    if not links:
        trust, distrust = {h: 0.15 * x for h, x in good.items()}, {h: 0.15 * x for h, x in bad.items()}
    else:
        trust, distrust = flow(good, links), flow(bad, [(b, a) for a, b in links])
    out = []
    for url in pages:
        host, path = parts(url)
        rule = rule_of(host, path)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        allow = rule.allow if rule else not d > 0.5 * (t + d)
        out.append((host, path, rule and rule.name, "allow" if allow else "block"))
    return out, trust, distrust


def test_rules_and_links(spark):
    link = lambda *hosts: "<p>" + "".join(f'<A class=x HREF = "https://{h}/p?q">t</a>' for h in hosts) + "<a href='/rel'>"
    pages = [
        ("http://A.com/x", link("b.org", "b.org", "c.org")), ("https://b.org", link("c.org")), ("https://c.org/?u#f", link("d.org", "spam.net")),
        ("http://spam.net/fr/1", link("e.org")), ("http://e.org/#x", link("spam.net")), ("http://f.org/en/", "<a href=//spam.net/x>y"),
        ("http://www.example.com/en/1", None), ("http://x.example.com/en/1", ""), ("http://example.com/fr/", link()), ("http://net/es/", None),
        ("no scheme", link("f.org")), (None, link("f.org")), ("://weird.com/", None), ("http://b.org/2", link("c.org")), ("http://com", None),
        ("ftp://Ünï.com/É", None), ("http://u:p@host.org:80/en/", None), ("http://d.org/a://b", link("d.org"))]
    links = {("a.com", "b.org"), ("a.com", "c.org"), ("b.org", "c.org"), ("c.org", "d.org"), ("c.org", "spam.net"), ("spam.net", "e.org"),
             ("e.org", "spam.net"), ("f.org", "spam.net")}
    df = frame(spark, [(i, u, h, "x", 1.0) for i, (u, h) in enumerate(pages)], SCHEMA)
    rows = sorted(judge_urls(df, RULES).collect(), key=lambda r: r["page_id"])
    want, trust, distrust = expected([u for u, _ in pages], links)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == want
    for r in rows:
        if r["host"]:
            assert r["trust"] == pytest.approx(trust.get(r["host"], 0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0))
    assert {r["host"]: r["verdict"] for r in rows}["f.org"] == "block"


def test_whole_table(spark):
    pages = [r["url"] for r in table(spark, SF, "pages").orderBy("page_id").collect()]
    rows = sorted(op10_url_trust(spark, SF).collect(), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == expected(pages, set())[0]


def test_empty(spark):
    assert judge_urls(frame(spark, [], SCHEMA), RULES).count() == 0
