"""URL verdicts from host/path rules, and from the link graph where no rule speaks.

Trust starts at hosts whose pages the allow rules fit and flows along links; distrust starts at
hosts whose pages the block rules fit and flows against links, to the hosts that point there.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

# A link with a host: scheme://host or //host, quoted or not.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
STEPS = 4  # of propagation between two written tables


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class GraphParams:
    """``damping``: share of a score that follows links. A host is blocked when its distrust is at
    least ``threshold`` and above its trust. Iteration ends once no score moves by ``tolerance``,
    or after ``rounds``, by when what is left to move is below damping ** rounds."""

    damping: float = 0.85
    threshold: float = 0.5
    tolerance: float = 1e-4
    rounds: int = 60


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of the part after the first ``://``; both empty for null or no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return lower_ascii(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def _rule_rows(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = [F.struct(F.lit(r.host).alias("suffix"), F.lit(r.path).alias("rule_path"), F.lit(r.verdict).alias("rule_verdict")) for r in rules]
    kind = "array<struct<suffix:string,rule_path:string,rule_verdict:string>>"
    return frame.sparkSession.range(1).select(F.inline(F.array(*rows).cast(kind) if rows else F.array().cast(kind)))


def host_rules(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, rules): the rules that fit each host or a domain above it, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.select("host", F.explode(suffixes).alias("suffix")).join(_rule_rows(hosts, rules), "suffix")
    length = -F.length(F.concat("suffix", "rule_path"))
    one = F.struct(length.alias("order"), "suffix", "rule_path", "rule_verdict")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """(host, other, weight): pages of ``host`` that link to ``other``, another host."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii))
    links = pages.where(F.col("host") != "").select("host", F.explode(found).alias("other"))
    return links.where(F.col("host") != F.col("other")).groupBy("host", "other").agg(F.count("*").cast("double").alias("weight"))


def propagate(hosts: DataFrame, links: DataFrame, params: GraphParams) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust_seed, distrust_seed).

    Both are personalised PageRank with the seeds as restart weights, as one linear system, so
    a score compares with a share of pages and does not depend on the number of hosts. Every host
    also keeps a self link of weight 1; without links its scores stay its seeds.
    """
    own = hosts.select("host", F.col("host").alias("other"), F.lit(1.0).alias("weight"))
    edges = materialise(links.unionByName(own), "host-edges")
    out = edges.groupBy("host").agg(F.sum("weight").alias("out_weight"))
    into = edges.groupBy("other").agg(F.sum("weight").alias("in_weight"))
    edges = edges.join(out, "host").join(into, "other")
    edges = materialise(edges.select("host", "other", (F.col("weight") / F.col("out_weight")).alias("forth"), (F.col("weight") / F.col("in_weight")).alias("back")), "host-shares")
    seeds = hosts
    state = hosts.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    done = 0
    while done < params.rounds:
        before = state
        for _ in range(STEPS):
            flow_on = edges.join(state, "host").groupBy(F.col("other").alias("host")).agg(F.sum(F.col("forth") * F.col("trust")).alias("t"))
            against = edges.join(state.select(F.col("host").alias("other"), "distrust"), "other").groupBy("host").agg(F.sum(F.col("back") * F.col("distrust")).alias("d"))
            kept = 1 - params.damping
            state = seeds.join(flow_on, "host", "left").join(against, "host", "left").select(
                "host",
                (kept * F.col("trust_seed") + params.damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                (kept * F.col("distrust_seed") + params.damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        done += STEPS
        state = materialise(state, "host-scores")
        old = before.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = state.join(old, "host").agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        if (moved or 0.0) < params.tolerance:
            break
    return state


def judge_urls(pages: DataFrame, rules: list[Rule], params: GraphParams = GraphParams()) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A rule fits its host and all hosts below it if the path starts with the rule's path; the
    longest host + path wins (equal lengths: the later in code-point order). Pages without a
    fitting rule get their host's verdict: blocked if its distrust is at least the threshold and
    above its trust, else allowed. Null urls and such without ``://`` have an empty host, which
    is no part of the graph and is allowed; null html has no links. Repeated rows stay repeated,
    and other columns are ignored, whatever their names. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    links = materialise(host_links(pages), "host-links")
    narrow = materialise(pages.drop("html"), "page-urls")
    rows = narrow.groupBy("host").count().select("host")
    fits = materialise(host_rules(rows.where(F.col("host") != ""), rules), "host-rules")
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    judged = materialise(narrow.join(fits, "host", "left").withColumn("best", best).select(
        "page_id", "host", "path", F.concat("best.suffix", "best.rule_path").alias("rule"), F.col("best.rule_verdict").alias("ruled")), "ruled-urls")
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    seeded = judged.where(F.col("host") != "").groupBy("host").agg(share("allow").alias("trust_seed"), share("block").alias("distrust_seed"))
    linked = links.select(F.col("other").alias("host")).distinct().join(seeded, "host", "left_anti")
    hosts = materialise(seeded.unionByName(linked.select("host", F.lit(0.0).alias("trust_seed"), F.lit(0.0).alias("distrust_seed"))), "host-seeds")
    scores = propagate(hosts, links, params)
    bad = (F.col("distrust") >= params.threshold) & (F.col("distrust") > F.col("trust"))
    by_graph = F.when(bad, "block").otherwise("allow")
    joined = judged.join(scores, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
