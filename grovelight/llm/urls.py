"""URL filters: prefix rules, and trust propagated over the link graph of hosts for everything the rules leave open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii, salt_of, salted, scratch

SALTS = 32
# A link to another host: href, an optional quote, an optional scheme, then //host.
LINK = "(?i)href[\\x20\\x09-\\x0D]*=[\\x20\\x09-\\x0D]*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'<>\\x20\\x09-\\x0D]+)"


def url_host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules of one length: block wins, then code points.

    ``rules`` are (verdict, host, path) and travel inside the plan, so this is for configured lists.
    """
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        this = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, this) if chosen is None else chosen.when(fits, this)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chosen is None else chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): share of a host's outgoing links; links within a host do not count."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    counted = (
        links.select("src", lower_ascii(F.col("to")).alias("dst"))
        .where((F.col("src") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    return counted


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 60, place=None
) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from trusted hosts along links, from blocked hosts against them.

    ``edges`` is (src, dst, n), ``seeds`` is (host, trusted, blocked) with weights that need not sum to 1. Both walks
    restart at their seeds with probability 1 - ``damping``; what reaches a host without links restarts too.
    All ``rounds`` run: scores shrink with the number of hosts, so no size of a change tells that the verdicts are settled. What
    is unsettled after them is below damping ** rounds. One round is one join and one sum on the edges, written to the shared
    folder; hosts stay distributed and one number per walk is broadcast.
    """
    place = place or scratch(edges.sparkSession)
    directed = edges.select(F.lit(0).alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        edges.select(F.lit(1).alias("walk"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    totals = directed.groupBy("walk", "a").agg(F.sum("n").alias("total"))
    arcs = place.cut(
        directed.join(totals, ["walk", "a"]).select("walk", "a", "b", (F.col("n") / F.col("total")).alias("share")), "arcs"
    )
    hosts = (
        seeds.select("host")
        .union(edges.select("src"))
        .union(edges.select("dst"))
        .distinct()
        .join(seeds.groupBy("host").agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")), "host", "left")
    )
    starts = hosts.select(F.lit(0).alias("walk"), "host", F.coalesce("trusted", F.lit(0)).cast("double").alias("w")).unionByName(
        hosts.select(F.lit(1).alias("walk"), "host", F.coalesce("blocked", F.lit(0)).cast("double").alias("w"))
    )
    sums = starts.groupBy("walk").agg(F.sum("w").alias("sum"))
    restart = starts.join(F.broadcast(sums), "walk").select(
        "walk", "host", F.when(F.col("sum") > 0, F.col("w") / F.col("sum")).otherwise(0.0).alias("restart")
    )
    leaving = totals.select("walk", F.col("a").alias("host"), F.lit(True).alias("linked"))
    score = place.cut(
        restart.join(leaving, ["walk", "host"], "left").select(
            "walk", "host", "restart", F.coalesce("linked", F.lit(False)).alias("linked"), F.col("restart").alias("score")
        ),
        "score",
        keep=2,
    )
    if arcs.isEmpty():
        return _side_by_side(score)  # without a link every walk stays where it starts
    for _ in range(rounds):
        moved = (
            score.join(arcs, (score["walk"] == arcs["walk"]) & (score["host"] == arcs["a"]))
            .groupBy(arcs["walk"].alias("m_walk"), F.col("b").alias("m_host"))
            .agg(F.sum(F.col("score") * F.col("share")).alias("moved"))
        )
        # what leaves hosts with links arrives somewhere; the rest restarts. Two rows
        lost = score.groupBy("walk").agg((F.sum("restart") - F.sum(F.when(F.col("linked"), F.col("score")).otherwise(0.0)) * damping).alias("again"))
        new = F.coalesce("moved", F.lit(0.0)) * damping + F.col("restart") * F.col("again")
        score = place.cut(
            score.join(moved, (F.col("walk") == F.col("m_walk")) & (F.col("host") == F.col("m_host")), "left")
            .join(F.broadcast(lost), "walk")
            .select("walk", "host", "restart", "linked", new.alias("score")),
            "score",
            keep=2,
        )
    return _side_by_side(score)


def _side_by_side(score: DataFrame) -> DataFrame:
    return score.groupBy("host").agg(
        F.sum(F.when(F.col("walk") == 0, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("walk") == 1, F.col("score")).otherwise(0.0)).alias("distrust"),
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: float = 0.5, rounds: int = 60) -> DataFrame:
    """Per page: page_id, url, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Other pages follow their host: it is blocked where distrust makes up more than
    ``threshold`` of its trust and distrust together, and allowed otherwise, also where neither reaches it. Seeds are
    the hosts of pages that a rule decides, weighted by those pages; the link graph comes from the pages' HTML.

    A null or malformed url has an empty host and path and is allowed; null or broken html has no links; repeated rows
    are judged alike (and weigh twice as seeds); empty tables and further columns are fine. A hot host is spread by a salt.
    """
    place = scratch(pages.sparkSession)
    base = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    base = base.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = (
        base.groupBy("host")
        .agg(F.count_if(F.col("ruled.verdict") == "allow").alias("trusted"), F.count_if(F.col("ruled.verdict") == "block").alias("blocked"))
        .where("host != ''")
    )
    seeds = place.cut(seeds, "seeds")
    edges = place.cut(host_edges(base.where("contains(html, '//')")), "edges")
    hosts = place.cut(propagate(edges, seeds, rounds=rounds, place=place), "hosts")
    doubtful = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    opinion = salted(hosts.select(F.col("host").alias("o_host"), "trust", "distrust", doubtful.alias("doubtful")), SALTS, "o_salt")
    return (
        base.drop("html")
        .withColumn("salt", salt_of(SALTS, "page_id", "url"))
        .join(opinion, (F.col("host") == F.col("o_host")) & (F.col("salt") == F.col("o_salt")), "left")
        .select(
            "page_id",
            "url",
            "host",
            "path",
            F.col("ruled.rule").alias("rule"),
            F.coalesce("ruled.verdict", F.when(F.col("doubtful"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "trust",
            "distrust",
        )
    )
