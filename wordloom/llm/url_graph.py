"""URL filtering by rules, and by trust and distrust that spread over links between hosts.

Trust starts from hosts with allowed pages, in proportion to their number, and
follows links; distrust starts likewise from hosts with blocked pages and goes
against them, from a host to those that link to it. Both are personalised
PageRank, summed up round by round until what is still under way can't turn any
host's verdict; a host with more distrust than trust is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import discard, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blocked hosts are broadcast up to this number, else joined by shuffle.
BROADCAST_HOSTS = 200_000
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]+)"


@dataclass(frozen=True)
class Rule:
    """Fits its host and that host's subdomains where the path begins with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query is asked for.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    at = F.locate("://", url)
    found = F.translate(F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(at, F.lit(0)) > 0, found).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host's ``://``."""
    at = F.locate("://", url)
    found = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, found).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Place in rules of the longest that fits, null if none does. For some hundred rules at most: they become one expression."""
    found: Column = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k].name), rules[k].name)):
        r = rules[k]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): absolute links between different hosts, counted; summed where they lie before the shuffle."""
    links = pages.select(F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), 1)).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    edges = links.select(host_of(F.col("url")).alias("src"), host_of(full).alias("dst"))
    return edges.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _by_kind(state: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind) for kind in ("trust", "distrust")]
    return state.groupBy("host").agg(*sums)


def _blocked(lead: Column, scale: Column, digits: int) -> Column:
    return lead > scale * 10.0**-digits


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, digits: int = 10, least: float = 1e-15) -> DataFrame:
    """(host, trust, distrust) of all hosts that either reaches. seeds: (host, kind, weight), kind trust or distrust.

    Edges are stored once, those of either kind in its own direction with the
    share of the giver's score that they pass on; each round is one join on the
    giver and one sum by the taker, and what a round's plan holds is cut every
    five rounds. A giver without edges passes nothing on. Scores only grow: with
    m the sum of what the last round brought, all further rounds bring at most
    m * damping / (1 - damping). It goes on until that can't turn the order of
    any host's two scores, to so many significant digits, or is below least.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    ahead = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("taker"), (F.col("n") / F.col("total") * damping).alias("share"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("taker"), (F.col("n") / F.col("total") * damping).alias("share"))
    moves = settle(ahead.unionByName(back))
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    first = F.col("weight") / F.col("all") * (1 - damping)
    given = seeds.join(F.broadcast(totals), "kind").select("kind", "host", first.alias("last"))
    # Hosts that are still to be reached stand there with nothing.
    reachable = moves.select("kind", F.col("taker").alias("host"), F.lit(0.0).alias("last"))
    state = settle(given.unionByName(reachable).groupBy("kind", "host").agg(F.sum("last").alias("last")).withColumn("score", F.col("last")))
    going = not moves.isEmpty()
    while going:
        before = state
        for _ in range(5):
            given = moves.join(state.filter("last > 0").select("kind", F.col("host").alias("giver"), "last"), ["kind", "giver"])
            taken = given.select("kind", F.col("taker").alias("host"), (F.col("last") * F.col("share")).alias("last")).withColumn("score", F.col("last"))
            state = state.withColumn("last", F.lit(0.0)).unionByName(taken).groupBy("kind", "host").agg(F.sum("last").alias("last"), F.sum("score").alias("score"))
        state = settle(state)
        discard(before)
        rest = {r["kind"]: r["n"] * damping / (1 - damping) for r in state.groupBy("kind").agg(F.sum("last").alias("n")).collect()}
        to_trust, to_distrust = rest.get("trust", 0.0), rest.get("distrust", 0.0)
        surely = _blocked(F.col("distrust") - F.col("trust") - to_trust, F.col("distrust"), digits)
        never = ~_blocked(F.col("distrust") + to_distrust - F.col("trust"), F.col("distrust") + to_distrust, digits)
        going = max(to_trust, to_distrust) > least and not _by_kind(state).filter(~(surely | never)).isEmpty()
    discard(moves)
    return _by_kind(state)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES, damping: float = 0.85, digits: int = 10) -> DataFrame:
    """(id_col, host, path, rule, verdict), a row for each row of pages.

    Where no rule fits, a page is blocked if its host has more distrust than
    trust (by more than the last of so many significant digits, so that the
    order of sums doesn't count, and small scores of large graphs do). A host
    counts as trusted, or distrusted, for each of its pages that a rule allows,
    or blocks; on both sides by their shares of all such pages.
    A host with no score, an empty one included, is allowed. A null or broken
    url has an empty host and path; null html has no links. Ids may be null or
    repeat; repeated pages repeat their links. Other columns are not read.
    """
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    urls = urls.select(id_col, "host", "path", F.get(names, F.col("_rule")).alias("rule"), F.get(verdicts, F.col("_rule")).alias("_verdict"))
    ruled = urls.filter("_verdict IS NOT NULL AND host <> ''").groupBy("host", "_verdict").agg(F.count("*").alias("weight"))
    seeds = ruled.select("host", F.when(F.col("_verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "weight")
    edges, seeds = settle(host_edges(pages, url_col, html_col)), settle(seeds)
    scores = propagate(edges, seeds, damping, digits)
    blocked = settle(scores.filter(_blocked(F.col("distrust") - F.col("trust"), F.col("distrust"), digits)).select(F.col("host").alias("_host")))
    discard(edges, seeds)
    if blocked.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        blocked = F.broadcast(blocked)
    both = urls.join(blocked, F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return both.select(id_col, "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"))
