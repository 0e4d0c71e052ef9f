import duckdb
import numpy as np
import pytest

from millrace.llm import queries
from millrace.llm.url_filter import DAMPING, RULES, UrlRule, filter_urls, propagate

PAGES = "page_id long, url string, html string"


def test_rules_equal_brute_force(spark):
    urls = ["http://WWW.Example.com/en/x?y#z", "https://blog.example.com/en/", "https://example.com/fr/1", "http://a.net/es/1", "http://a.net/de/1", "x://net/fr/", "no scheme", None, "", "http://com", "http://xcom/", "http://a.com?q=/en/", "http://example.com/EN/", "a://b://example.net/es/", "http://www.example.com/en/://", "http:///x"]
    rows = filter_urls(spark.createDataFrame(list(enumerate(urls)) and [(i, u, None) for i, u in enumerate(urls)], PAGES)).collect()
    for r in rows:
        url = urls[r["page_id"]] or ""
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.host + best.path)
        assert best is None or r["verdict"] == best.action
    assert len(rows) == len(urls)


def walks(hosts, links, seeds, rounds):
    """Power iteration by dense arrays: trust, distrust, trusted, blame."""
    at = {h: i for i, h in enumerate(hosts)}
    forward = np.zeros((len(hosts), len(hosts)))
    for s, t, n in links:
        forward[at[s], at[t]] += n
    over = lambda m: np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
    ahead, back = over(forward), over(forward.T)
    trust, distrust = (np.array([seeds.get(h, (0.0, 0.0))[k] for h in hosts]) for k in (0, 1))
    out = []
    for seed, step in ((trust, ahead.T), (distrust, back.T), (np.ones(len(hosts)), ahead.T), (distrust, ahead)):
        score = (1 - DAMPING) * seed
        for _ in range(rounds):
            score = (1 - DAMPING) * seed + DAMPING * step @ score
        out.append(score)
    t, d, p, b = out
    return t / (t.sum() or 1), d / (d.sum() or 1), t / p, b


def test_walks_equal_power_iteration(spark):
    rng = np.random.default_rng(6)
    hosts = [f"h{i}" for i in range(2000)]
    # A few hubs get a third of the links, some hosts have none.
    links = {}
    for _ in range(9000):
        s, t = rng.integers(0, 1900), rng.integers(0, 5) if rng.random() < 0.33 else rng.integers(0, 2000)
        if s != t:
            links[hosts[s], hosts[t]] = int(rng.integers(1, 4))
    links = [(s, t, n) for (s, t), n in links.items()]
    seeds = {hosts[i]: (float(rng.random() < 0.3), 0.0) if i % 7 else (0.0, 1.0) for i in range(0, 2000, 3)}
    rows = propagate(spark.createDataFrame(links, "source string, target string, n long"), spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), rounds=7).collect()
    got = {r["host"]: r for r in rows}
    hosts = sorted(set(seeds) | {x for link in links for x in link[:2]})
    assert sorted(got) == hosts
    for name, want in zip(("trust", "distrust", "trusted", "blame"), walks(hosts, links, seeds, 7), strict=True):
        assert np.allclose([got[h][name] for h in hosts], want, atol=1e-12), name
    assert abs(sum(r["trust"] for r in rows) - 1) < 1e-9 and abs(sum(r["distrust"] for r in rows) - 1) < 1e-9
    assert all(0 <= r["trusted"] <= 1 + 1e-9 and 0 <= r["blame"] <= 1 for r in rows)


def test_links_spread_blame(spark):
    page = lambda i, host, *to: (i, f"https://{host}/x", "".join(f'<a class=k href="https://{t}/y">' for t in to))
    rows = [page(0, "farm.org", "spam.net"), page(1, "good.org"), page(2, "ok.com", "good.org", "fine.org"), page(3, "fine.org", "good.org"), (4, "https://spam.net/es/1", "<a href='//farm.org/'>"), (5, "https://spam.net/de/1", None)]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block"}
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    assert filter_urls(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as rule", "3 as trust")).count() == 6


@pytest.mark.parametrize("linkers", [1, 2, 1000])
def test_blame_does_not_thin_out_among_many_linkers(spark, linkers):
    farm = [(i, f"https://farm{i}.org/x", "<a href='//spam.net/'>") for i in range(linkers)]
    mostly_good = (2000, "https://paper.org/x", "<a href='//spam.net/'>" + "".join(f"<a href='//site{k}.org/'>" for k in range(9)))
    rows = [*farm, mostly_good, (2001, "https://spam.net/es/1", None)]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**dict.fromkeys(range(linkers), "block"), 2000: "allow", 2001: "block"}


def test_trusted_hosts_outweigh_a_bad_link_and_repeats_agree(spark):
    # press.com is allowed by its rule's host only; mirror.org is linked by it alone, and links half to spam.
    rows = [(i, f"https://press.com/{i}", "<a href='//mirror.org/'>") for i in range(3)] + [(9, "https://mirror.org/", "<a href='//spam.net/'><a href='//press.com/'>"), (10, "https://spam.net/fr/", None)]
    rows += [(9, "https://mirror.org/", "<a href='//spam.net/'><a href='//press.com/'>")]
    got = sorted({(r["page_id"], r["verdict"]) for r in filter_urls(spark.createDataFrame(rows, PAGES)).collect()})
    assert got == [(0, "allow"), (1, "allow"), (2, "allow"), (9, "allow"), (10, "block")]


def test_long_urls_pages_and_equally_long_rules(spark):
    rules = [UrlRule("allow", "ab.c", "/x"), UrlRule("block", "b.c", "/xyz")]
    tie = [UrlRule("allow", "a.b", "/"), UrlRule("block", "a.b", "/")]
    rows = [(1, "https://ab.c/x" + "y" * 100_000, "<p>" * 300_000 + "<a href='//far.org/'>"), (2, "https://a.b/", None)]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got[1]["verdict"] == "allow" and len(got[1]["path"]) == 100_002
    assert [r["verdict"] for r in filter_urls(spark.createDataFrame(rows[1:], PAGES), tie).collect()] == ["block"]


def test_the_sql_walks_links_too(spark, tmp_path):
    rows = [(i, f"https://farm{i}.org/x", "<a href='//spam.net/'>") for i in range(3)] + [(3, "https://paper.org/x", "<a href='//spam.net/'> <A class=x HREF=//User@Good.COM:80/a> <a href='https://b.org'><a href='/r'>"), (4, "https://spam.net/es/1", "<a href='//farm1.org/'>"), (5, "https://good.com/", ""), (6, None, "<a href='//x.net'>")]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    query = queries.QUERIES["op2_url_filter"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(query.columns)} FROM ({queries.ORACLE_SQL['op2_url_filter']}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in query.orderBy("page_id").collect()] == want
    assert [w[4] for w in want] == ["block"] * 5 + ["allow"] * 2
