"""URL rules, and ranks of hosts propagated along links, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds go on until no rank changes by more than this share of itself, but no longer than ``ROUNDS``.
CHANGE, ROUNDS = 1e-6, 200
#: So many rounds run between two writes to the shared folder.
EVERY = 5
#: A host is blocked above this share of distrust among trust and distrust; shares that differ by less than ``EVEN`` from it are even.
CUT, EVEN = 0.5, 1e-4
#: So many rules at most are compared as literals; more are joined.
LITERAL_RULES = 200


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits host and path (of equal lengths the last by text); else null."""
    if len(rules) > LITERAL_RULES:
        return _joined_rule(pages, rules)
    best: Column = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fitting = [
        F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    if fitting:
        best = F.array_max(F.array(*fitting))
    return pages.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict")).drop("_best")


def _joined_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for many rules: an equi-join of each distinct host's suffixes with the rules' hosts."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, verdict string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = pages.select("host", "path").distinct()
    fits = keys.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where("startswith(path, rule_path)")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("b"))
    return pages.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict")), ["host", "path"], "left")


#: Targets of links with a host, with or without a scheme.
_LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
_LINK_HOST = r"(?s)^[^/]*//([^/?#]*)"


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Links between different hosts: src, dst, n (how many). Targets without a host are inside their page's."""
    targets = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), targets.alias("to"))
    named = links.select("src", F.translate(F.regexp_extract("to", _LINK_HOST, 1), _UPPER, _LOWER).alias("dst")).where("dst <> '' and dst <> src")
    return named.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, rounds: int = ROUNDS, damping: float = DAMPING, change: float = CHANGE) -> DataFrame:
    """Personalised PageRank of several kinds: (kind, host, rank), the ranks of a kind summing to 1.

    From ``seeds`` (kind, host, seed) along ``edges`` (kind, src, dst, n). What
    reaches a host without links goes back to the seeds: that scales all ranks
    of a kind by one factor, so it is left out and the ranks are scaled in the
    end. Rounds go on until the hosts reached and their ranks stop changing;
    hosts more than ``rounds`` links away count as not reached. Copies of a
    link were summed up before, so each round moves one row per pair of hosts,
    summed before its shuffle.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = scratch.table(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{name}-edges")
    base = ranks = scratch.table(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")), f"{name}-seeds")
    before = ranks
    for i in range(0 if shares.isEmpty() else rounds):
        sent = shares.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = sent.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % EVERY == 0:
            ranks = scratch.table(ranks, f"{name}-{i}")
            old = before.withColumnRenamed("rank", "old")
            if ranks.join(old, ["kind", "host"], "left").where(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) > change * F.col("rank")).isEmpty():
                break
            before = ranks
    total = ranks.groupBy("kind").agg(F.sum("rank").alias("total"))
    return ranks.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))  # a row per kind


def host_verdicts(pages: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, host_verdict) for pages with host, rule_verdict and html.

    Seeds are the hosts of pages that a rule allows (trust) or blocks
    (distrust), weighted by their pages. Trust follows the links, distrust goes
    against them: who links to a blocked host is suspect. Both sum to 1 over
    all hosts. A host is blocked when its share of distrust is over ``CUT``;
    one that neither reaches is allowed.
    """
    counts = scratch.table(pages.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad")), "hosts")
    edges = scratch.table(host_edges(pages), "edges")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    seeds = counts.select("host", F.explode(F.create_map(F.lit("trust"), "good", F.lit("distrust"), "bad")).alias("kind", "seed")).where("seed > 0")
    seeds = seeds.join(F.broadcast(seeds.groupBy("kind").agg(F.sum("seed").alias("all"))), "kind").withColumn("seed", F.col("seed") / F.col("all"))  # a row per kind
    ranks = propagate(both, seeds, scratch, "ranks", rounds)
    side = lambda kind: ranks.where(F.col("kind") == kind).select("host", F.col("rank").alias(kind))
    joined = counts.select("host").join(side("trust"), "host", "left").join(side("distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    blocked = F.col("distrust") > (CUT + EVEN) * (F.col("trust") + F.col("distrust"))
    return joined.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: list[Rule], scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has an empty host and path, no rule,
    and is allowed. A null html has no links; html of any length is searched
    whole. Repeated rows are judged each, and their links count each. Even
    shares of trust and distrust allow. An empty table gives no rows; other
    columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = with_rule(own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), rules)
    hosts = scratch.table(host_verdicts(own, scratch), "verdicts")
    judged = own.select("page_id", "host", "path", "rule", "rule_verdict").join(hosts, "host", "left")
    verdict = F.coalesce("rule_verdict", "host_verdict", F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def sql(rules: list[Rule], rounds: int = 130) -> str:
    """The same over the view ``pages`` for DuckDB, with a fixed number of rounds: page_id, host, path, rule, verdict."""
    lower = "translate({u}, '" + _UPPER + "', '" + _LOWER + "')"
    host = lower.format(u="coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    linked = lower.format(u=f"regexp_extract(t, '{_LINK_HOST}', 1)")
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    link = _LINK.replace("'", "''")
    return f"""
with recursive split as (select page_id, html, {host} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules(rule_host, rule_path, verdict) as (values {listed}),
fit as (select distinct host, path, first_value(rule_host || rule_path) over w as rule, first_value(verdict) over w as verdict
  from (select distinct host, path from split) join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  window w as (partition by host, path order by length(rule_host || rule_path) desc, rule_host || rule_path desc)),
ruled as (select page_id, html, s.host, s.path, rule, verdict from split s left join fit f on s.host = f.host and s.path = f.path),
hosts as (select host, count(*) filter (where verdict = 'allow') as good, count(*) filter (where verdict = 'block') as bad from ruled where host <> '' group by host),
links as (select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as t from ruled where host <> ''),
edges as (select src, dst, cast(count(*) as double) as n from (select src, {linked} as dst from links) where dst <> '' and dst <> src group by 1, 2),
shares as materialized (select 1 as kind, src as a, dst as b, n / sum(n) over (partition by src) as share from edges union all select 2, dst, src, n / sum(n) over (partition by dst) from edges),
seeds as materialized (select kind, host, {1 - DAMPING} * seed / sum(seed) over (partition by kind) as rank from (select 1 as kind, host, good as seed from hosts union all select 2, host, bad from hosts) where seed > 0),
walk as (select 0 as round, kind, host, rank from seeds union all
  select round + 1, kind, host, sum(rank) from (
    select w.round, w.kind, s.b as host, w.rank * s.share * {DAMPING} as rank from walk w join shares s on s.kind = w.kind and s.a = w.host where w.round < {rounds}
    union all select r.round, s.kind, s.host, s.rank from (select distinct round from walk where round < {rounds}) r, seeds s) group by 1, 2, 3),
last as (select kind, host, rank / sum(rank) over (partition by kind) as rank from walk where round = {rounds}),
ranks as (select h.host, coalesce(t.rank, 0) as trust, coalesce(d.rank, 0) as distrust from hosts h left join last t on t.host = h.host and t.kind = 1 left join last d on d.host = h.host and d.kind = 2)
select page_id, r.host, path, rule, coalesce(verdict, case when distrust > {CUT + EVEN} * (trust + distrust) then 'block' end, 'allow') as verdict
from ruled r left join ranks k on k.host = r.host
"""
