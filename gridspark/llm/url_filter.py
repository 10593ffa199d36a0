"""URL filter: address rules first, then trust and distrust that travel over links between hosts.

Rules name a host and the beginning of a path. Where none fits, the host decides. Pages that a
rule allows are seeds of trust, pages that a rule blocks are seeds of distrust, one unit each.
Trust follows the links (personalised PageRank from the trusted seeds), distrust goes against them:
who links to a blocked host is suspect. A host falls where its distrust is beyond its trust times a
threshold.

Masses are whole numbers and every step rounds down, row by row, so sums have no order and the
result is the same on any partitioning. A walk that reaches a host without links ends there. After
``rounds`` steps at most ``tolerance`` of the seeds' mass is still under way and is left out.

A round is one join of the hosts' masses with the messages (one row per linked pair) and one sum
that combines before the shuffle; a stored table ends the lineage every few rounds. The pages
themselves are shuffled once at most, to meet the table of hosts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of every absolute link of a page; other links stay on their host.
LINK = r"""[\x09\x0A\x0C\x0D\x20"'/][Hh][Rr][Ee][Ff][\x09\x0A\x0C\x0D\x20]*=[\x09\x0A\x0C\x0D\x20]*["']?(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#"'<>\x09\x0A\x0C\x0D\x20]+)"""


@dataclass(frozen=True)
class Settings:
    #: (host, path, verdict): fits the host and its subdomains where the path starts so.
    rules: Sequence[tuple[str, str, str]] = (
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"), ("com", "/de/", "block"))
    damping: float = 0.75
    tolerance: float = 0.02
    #: Links that a host and the domain above it (of two labels or more) exchange; 0: none.
    kin: int = 1
    #: Blocked where distrust > threshold * trust.
    threshold: float = 1.0
    #: Mass of a seed page, so that rounding stays far below one page.
    unit: int = 1_000_000
    rounds_per_cut: int = 4

    @property
    def rounds(self) -> int:
        return ceil(log(self.tolerance) / log(self.damping))


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return fold(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _above(host: Column) -> Column:
    """The host itself and every domain above it, as an array."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those that may fit pages of the host, the longest first."""
    named = rules.select(fold("host").alias("_rule_host"), "path", "verdict", F.concat(fold("host"), "path").alias("rule")).distinct()
    fits = hosts.select("host", F.explode(F.array_distinct(_above(F.col("host")))).alias("_rule_host")).join(named, "_rule_host")
    entry = F.struct((-F.length("rule")).alias("n"), (-F.length("_rule_host")).alias("m"), "rule", "path", "verdict")
    return fits.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def judged_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict (both null where no rule fits)."""
    rest = pages.select("page_id", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)])
    table = cut(rules_by_host(rest.select("host").distinct(), rules))
    both = rest.join(table, "host", "left")
    hit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return both.select("page_id", "host", "path", hit.alias("_hit")).select(
        "page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("verdict"))


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many pages of src link to the other host dst."""
    host, _ = host_and_path(F.col("url"))
    found = pages.filter(F.contains(F.col("html"), F.lit("//"))).select(
        host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), fold))).alias("dst"))
    return found.filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def kin(hosts: DataFrame, n: int) -> DataFrame:
    """src, dst, n: each host and the domain right above it, both ways, up to the domain of two labels."""
    chain = F.filter(_above(F.col("host")), lambda h: F.instr(h, ".") > 0)
    steps = hosts.select(F.explode(F.arrays_zip(
        F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))).alias("a"), F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0))).alias("b"))).alias("s"))
    up = steps.select("s.a", "s.b").distinct()
    both = up.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(up.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.withColumn("n", F.lit(n).cast("long"))


def messages(edges: DataFrame) -> DataFrame:
    """src, dst, trust, distrust: the share of a host's mass that goes to dst; a row to itself carries its sums on."""
    edges = edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    gives = edges.groupBy("src").agg(F.sum("n").alias("gives"))
    takes = edges.groupBy("dst").agg(F.sum("n").alias("takes"))
    zero = F.lit(0.0)
    along = edges.join(gives, "src").select("src", "dst", (F.col("n") / F.col("gives")).alias("trust"), zero.alias("distrust"))
    against = edges.join(takes, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), zero.alias("trust"), (F.col("n") / F.col("takes")).alias("distrust"))
    pairs = along.unionByName(against).groupBy("src", "dst").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust"))
    both = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    return pairs.unionByName(both.select("src", F.col("src").alias("dst"), zero.alias("trust"), zero.alias("distrust")))


def propagate(seeds: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, trust, distrust after all rounds.

    ``seeds``: host, trust, distrust (masses). ``edges``: src, dst, n (above 0); edges of a host to
    itself are not read. Hosts in neither table have no row; hosts in seeds alone keep their seeds.
    """
    s = settings
    posts = cut(messages(edges.filter("src <> dst")))
    seeds = seeds.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    linked = posts.filter("src = dst").select(F.col("src").alias("host"))
    alone = seeds.join(linked, "host", "left_anti")
    zero = F.lit(0).cast("long")
    now = linked.join(seeds, "host", "left").select(
        "host", F.coalesce("trust", zero).alias("t"), F.coalesce("distrust", zero).alias("b"), zero.alias("trust"), zero.alias("distrust"))
    for k in range(1, s.rounds + 1):
        step = lambda mass, share: F.floor(F.col(mass) * F.lit(s.damping) * F.col(share)).cast("long")
        keeps = lambda c, mass: F.when(F.col("src") == F.col("dst"), F.col(f"s.{c}") + F.col(mass)).otherwise(zero)
        sent = now.alias("s").join(posts.alias("p"), F.col("s.host") == F.col("p.src")).select(
            F.col("dst").alias("host"), step("t", "p.trust").alias("t"), step("b", "p.distrust").alias("b"),
            keeps("trust", "t").alias("trust"), keeps("distrust", "b").alias("distrust"))
        now = sent.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("t", "b", "trust", "distrust")])
        if k % s.rounds_per_cut == 0 and k < s.rounds:
            now = cut(now)
            if not now.filter("t > 0 or b > 0").limit(1).count():
                break
    ended = now.select("host", (F.col("trust") + F.col("t")).alias("trust"), (F.col("distrust") + F.col("b")).alias("distrust"))
    return ended.unionByName(alone)


def judge(pages: DataFrame, rules: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of ``pages`` (page_id, url, html).

    ``rules``: host, path, verdict (``allow`` or ``block``); of those that fit, the one with the
    longest host and path together wins, then the one with the longer host. Null and malformed
    addresses have an empty host and path and no rule, and are allowed. Null html has no links.
    Repeated rows are judged alike and each is a seed; a long page is searched whole. Hosts without
    any mass are allowed, so a table without seeds is allowed as a whole; an empty table gives an
    empty one. Other columns of ``pages`` are not read.
    """
    s = settings
    if rules is None:
        rules = pages.sparkSession.createDataFrame(list(s.rules), "host string, path string, verdict string")
    judged = cut(judged_by_rules(pages, rules))
    count = lambda v: (F.sum((F.col("verdict") == v).cast("long")) * s.unit).alias({"allow": "trust", "block": "distrust"}[v])
    seeds = judged.filter("rule is not null and host <> ''").groupBy("host").agg(count("allow"), count("block"))
    found = cut(links(pages))
    edges = [found]
    if s.kin:
        hosts = judged.select("host").unionByName(found.select(F.col("dst").alias("host"))).filter("host <> ''").distinct()
        edges.append(kin(hosts, s.kin))
    mass = cut(propagate(seeds, reduce(DataFrame.unionByName, edges), s))
    bad = F.coalesce(F.col("distrust") > s.threshold * F.col("trust"), F.lit(False))
    own = F.when(bad, "block").otherwise("allow")
    nil = F.lit(0).cast("long")
    return judged.join(mass, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
        F.coalesce("trust", nil).alias("trust"), F.coalesce("distrust", nil).alias("distrust"))
