import math
import re
from collections import Counter, defaultdict

import pytest

from gridspark.llm.url_filter import LINK, Settings, judge, links, propagate

COLUMNS = "page_id long, url string, html string, host string, rule string, src int"


def fold(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return fold(host), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_of(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def masses(seeds, edges, s):
    """Two power series in plain Python."""
    gives, takes = Counter(), Counter()
    for (a, b), n in edges.items():
        gives[a] += n
        takes[b] += n
    total = {h: list(m) for h, m in seeds.items()}
    now = dict(seeds)
    for _ in range(s.rounds):
        new = defaultdict(lambda: [0, 0])
        for (a, b), n in edges.items():
            new[b][0] += math.floor(now.get(a, (0, 0))[0] * s.damping * (n / gives[a]))
            new[a][1] += math.floor(now.get(b, (0, 0))[1] * s.damping * (n / takes[b]))
        now = new
        for h, m in new.items():
            t = total.setdefault(h, [0, 0])
            t[0] += m[0]
            t[1] += m[1]
    return {h: tuple(m) for h, m in total.items()}


def brute(rows, s):
    seen = [(i, *parts(u), html) for i, u, html, *_ in rows]
    edges, seeds, hosts = Counter(), defaultdict(lambda: [0, 0]), set()
    for _, host, path, html in seen:
        if not host:
            continue
        hosts.add(host)
        _, v = rule_of(host, path, s.rules)
        if v:
            seeds[host][v == "block"] += s.unit
        for d in {fold(x) for x in re.findall(LINK, html or "")} - {host}:
            edges[host, d] += 1
            hosts.add(d)
    if s.kin:
        above = set()
        for h in hosts:
            while h.count(".") > 1:
                above.add((h, h := h.split(".", 1)[1]))
        for a, b in above:
            edges[a, b] += s.kin
            edges[b, a] += s.kin
    mass = masses(seeds, edges, s)
    out = []
    for i, host, path, _ in seen:
        rule, v = rule_of(host, path, s.rules)
        t, b = mass.get(host, (0, 0))
        out.append((i, host, path, rule, v or ("block" if b > s.threshold * t else "allow"), t, b))
    return sorted(out, key=str)


def got(spark, rows, s):
    df = spark.createDataFrame(rows, COLUMNS)
    return sorted((tuple(r) for r in judge(df, settings=s).collect()), key=str)


def page(i, url, *to):
    return (i, url, "".join(f'<a class=x HREF = "{t}">y</a>' for t in to), "own", "r", 1)


WEB = [
    page(1, "http://Good.ORG/a", "https://friend.net/x", "//friend.net/y", "/own", "http://good.org/self"),
    page(2, "http://friend.net/?q=1", "http://far.net:80/z"),
    page(3, "https://bad.com/de/7", "http://victim.net/"),
    page(4, "https://spam.net/p#x", "https://BAD.com/de/", "https://bad.com/de/2"),
    page(5, "https://ring.net", "https://spam.net/"),
    page(6, "https://bad.com/fr/1"), page(6, "https://bad.com/fr/1"),
    page(7, "https://www.example.org/es/1"), page(8, "https://www.example.org/en/12"), page(9, "https://www.example.org/en/2"),
    page(10, "https://org"), page(11, "https://notorg/"), page(12, "no address"), (13, None, None, None, None, None),
    (None, "https://blog.x.bad.com/en/", "a" * 300_000 + ' href=http://bad.com/', "", "", 0), page(14, "http:///de/", "http://bad.com"),
]


@pytest.mark.parametrize("s", [Settings(), Settings(kin=0, damping=0.5, tolerance=0.2), Settings(threshold=0.2, tolerance=0.3, rounds_per_cut=2)])
def test_equals_brute_force(spark, s):
    assert got(spark, WEB, s) == brute(WEB, s)


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    s = Settings(kin=0, tolerance=0.4)
    by = {r[1]: r for r in got(spark, WEB, s)}
    assert by["friend.net"][5] > 0 and by["friend.net"][6] == 0
    assert by["spam.net"][4] == "block" and by["ring.net"][4] == "block" and by["spam.net"][6] > by["ring.net"][6]
    assert {r.src: r.n for r in links(spark.createDataFrame(WEB, COLUMNS)).filter("dst = 'bad.com'").collect()} == {"spam.net": 1, "blog.x.bad.com": 1}


def test_empty_tables_and_tables_without_seeds(spark):
    s = Settings(tolerance=0.5)
    assert got(spark, [], s) == []
    rows = [page(1, "http://a.net/"), (2, None, None, None, None, None)]
    assert [r[4] for r in got(spark, rows, s)] == ["allow", "allow"]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in judge(spark.createDataFrame(WEB, COLUMNS), none, s).collect()} == {"allow"}


def test_longest_rule_and_ties_of_length(spark):
    rules = [("b.net", "/x", "block"), ("a.b.net", "/", "allow"), ("B.net", "/xyz", "block"), ("net", "", "allow")]
    pages = spark.createDataFrame([page(1, "http://a.b.net/xy"), page(2, "http://a.b.net/xyz1"), page(3, "http://b.net/q"), page(4, "http://b.net")], COLUMNS)
    out = judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    # b.net/xyz and a.b.net/ are equally long: the longer host wins.
    assert {r.page_id: (r.rule, r.verdict) for r in out.collect()} == {1: ("a.b.net/", "allow"), 2: ("b.net/xyz", "block"), 3: ("net", "allow"), 4: ("net", "allow")}


def test_propagation_equals_power_series_on_a_random_graph(spark):
    import random

    rnd = random.Random(3)
    hosts = [f"h{i}" for i in range(40)]
    edges = Counter((a, b) for a, b in ((rnd.choice(hosts), rnd.choice(hosts)) for _ in range(200)) if a != b)
    seeds = {h: [rnd.randrange(10**7), rnd.randrange(10**7)] for h in rnd.sample(hosts, 9)}
    s = Settings()
    out = propagate(spark.createDataFrame([(h, *m) for h, m in seeds.items()], "host string, trust long, distrust long"),
                    spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), s)
    assert {r.host: (r.trust, r.distrust) for r in out.collect() if r.trust or r.distrust} == {h: m for h, m in masses(seeds, edges, s).items() if any(m)}
