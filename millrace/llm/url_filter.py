"""URL rules, and a link graph that judges the hosts they don't decide.

A rule allows or blocks a host with all its subdomains under a path; the longest rule that fits decides. For other urls, four
walks over the links between hosts, weighted by their number, spread from seeds (the shares of a host's pages that rules allow
or block):

* trust: personalised PageRank from the trusted seeds, along the links;
* distrust: personalised PageRank from the blocked seeds, along the reversed links;
* rank: PageRank from all hosts alike. Trust over rank, before either is normalised, is the share of a host's rank that comes
  from trusted seeds, whatever the size of the graph;
* blame: the share of a personalised PageRank that starts at the host itself and ends on blocked pages. Distrust is divided among
  all that link to a bad host, so it says nothing of how bad one of them is; blame takes the mean of the host's own links,
  which other linkers don't lessen.

A host is blocked if its blame reaches ``least_blame`` and exceeds its share of trust. Trust and distrust are returned as
probabilities: a walk's mass that reaches hosts without links returns to its seeds, which is the same as dividing
by the sum in the end.

Hosts and links are aggregated tables that stay in Spark; each few rounds they are written to the shared folder. With no
link between hosts the seeds are the scores, and no round runs.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged as the host ``""``; null
html has no links; urls and pages of any length are read whole; of rules that fit and are equally long the later one in the
list decides; repeated rows are judged alike (and count in their host's seeds and links); an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.joins import keyed
from millrace.llm.store import Tables, materialise
from millrace.llm.text import ascii_lower

DAMPING = 0.85
ROUNDS = 20
#: A host's own blocked pages give blame of (1 - damping) times their share: half of its pages, by default.
LEAST_BLAME = 0.5 * (1 - DAMPING)
_WRITE_EVERY = 5
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


class UrlRule(NamedTuple):
    action: str
    host: str
    path: str


# The contract's rules.
RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/")]


def url_part(url: Column, part: int) -> Column:
    """1: the host, A-Z lower-cased; 2: the path."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", part)
    return ascii_lower(found) if part == 1 else found


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """(rule, action) of the longest rule that fits, else null. The list is a parameter, tried longest first."""
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))).otherwise(chosen)
    return chosen


def judged_pages(pages: DataFrame, rules: list[UrlRule], id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path, rule, action."""
    rows = pages.select(F.col(id_col).alias("page_id"), url_part(F.col(url_col), 1).alias("host"), url_part(F.col(url_col), 2).alias("path"))
    return rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.action")


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """source, target, n: links between different hosts, counted before the shuffle."""
    links = pages.select(url_part(F.col(url_col), 1).alias("source"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("t"))
    links = links.select("source", F.regexp_replace(ascii_lower(F.col("t")), "^.*@|:[0-9]*$", "").alias("target"))
    return links.where((F.col("source") != F.col("target")) & (F.col("source") != "") & (F.col("target") != "")).groupBy("source", "target").agg(F.count("*").alias("n"))


#: A walk's letter, the links' ends it goes from and to, whose links add up to 1, and the seeds' column.
_WALKS = [("t", "source", "target", "source", "trust"), ("d", "target", "source", "target", "distrust"), ("p", "source", "target", "source", "one"), ("b", "target", "source", "source", "distrust")]


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, trusted (share of its rank), blame. ``links``: source, target, n; ``seeds``: host, trust,
    distrust, each 0 to 1. All walks go in the same rounds, as rows of one table."""
    with Tables(links.sparkSession) as tables:
        return materialise(_walks(links, seeds, damping, rounds, tables), "hosts")


def _walks(links: DataFrame, seeds: DataFrame, damping: float, rounds: int, tables: Tables) -> DataFrame:
    links = tables.write(links, "links")
    hosts = seeds.select("host").unionAll(links.select("source")).unionAll(links.select("target")).distinct().withColumnRenamed("host", "host_a")
    known = hosts.join(seeds, F.col("host_a") == F.col("host"), "left").select(F.col("host_a").alias("host"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")], F.lit(1.0).alias("one"))
    kinds = F.explode(F.array(*[F.struct(F.lit(w[0]).alias("kind"), F.col(w[4]).alias("seed")) for w in _WALKS]))
    base = tables.write(known.select("host", kinds.alias("x")).select("host", "x.*"), "seeds")
    scores = base.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score"))
    if not links.isEmpty():
        both = reduce(DataFrame.unionAll, [links.select(F.lit(k).alias("kind"), F.col(of).alias("host"), F.col(to).alias("to"), "n", F.col(by).alias("by")) for k, of, to, by, _ in _WALKS])
        edges = keyed(both, both.groupBy("kind", "by").agg(F.sum("n").alias("out")), ["kind", "by"])
        edges = tables.write(edges.select("kind", "host", "to", (F.col("n") / F.col("out")).alias("w")), "edges")
        held = None
        for k in range(1, rounds + 1):
            arrived = keyed(edges, scores, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("w") * F.col("score")).alias("in"))
            scores = base.join(arrived, ["kind", "host"], "left").select("host", "kind", (F.col("seed") * (1 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("score"))
            if k % _WRITE_EVERY == 0 or k == rounds:
                scores = tables.write(scores, "scores")
                if held is not None:
                    tables.drop(held)
                held = scores
    sums = {r["kind"]: r["s"] for r in scores.groupBy("kind").agg(F.sum("score").alias("s")).collect()}  # four rows
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
    share = lambda kind: (of(kind) / (sums.get(kind) or 1.0))
    return scores.groupBy("host").agg(share("t").alias("trust"), share("d").alias("distrust"), (of("t") / of("p")).alias("trusted"), of("b").alias("blame"))


def filter_urls(pages: DataFrame, rules: list[UrlRule] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_blame: float = LEAST_BLAME, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, trusted, blame: one row a page."""
    judged = judged_pages(pages, RULES if rules is None else rules, id_col, url_col)
    share = lambda a: (F.count(F.when(F.col("action") == a, 1)) / F.count("*"))
    seeds = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    # A written table, so that the join below deals both sides out anew and the pages of a large host can be split.
    hosts = propagate(host_links(pages, url_col, html_col), seeds, damping, rounds)
    bad = (F.col("blame") > F.col("trusted")) & (F.col("blame") >= least_blame)
    verdict = F.coalesce("action", F.when(bad, "block").otherwise("allow"))
    joined = judged.join(hosts.withColumnRenamed("host", "host_h"), F.col("host") == F.col("host_h"), "left")
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust", "trusted", "blame")
