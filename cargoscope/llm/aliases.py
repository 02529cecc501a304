"""URL verdicts by rules, carried over redirects and canonical links.

A rule names a host and the beginning of a path; the longest that fits decides.  A URL that no
rule fits takes part in its group of aliases: URLs joined by redirects (given, or a page's refresh
tag) and canonical links.  Groups are connected components found by rounds of joins.  A group with
a URL that a rule blocks is blocked; a URL that a rule itself allows stays allowed.  Everything is
DataFrame functions; rules meet hosts by suffix joins, so neither side goes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.llm import common, graph

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF, TARGET = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased (A-Z) host and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return common.ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)


def _located(df: DataFrame, url: str) -> DataFrame:
    host, path = host_path(F.col(url))
    return df.withColumns({"host": host, "path": path})


def judged(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled) for distinct nodes (host, path); null where no rule fits.

    Of fitting rules the longest wins, of equally long ones the one with the longer host.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("start"), "verdict").where("rule_host is not null and verdict is not null").withColumn(
        "start", F.coalesce("start", F.lit(""))).dropDuplicates(["rule_host", "start"])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = nodes.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").where("startswith(path, start)")
    best = met.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("start")).alias("size"), F.length("rule_host").alias("own"), F.concat("rule_host", "start").alias("rule"), "verdict")).alias("b"))
    return nodes.join(best, ["host", "path"], "left").select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("ruled"))


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(host, path, to_host, to_path) for canonical and refresh links of pages, and for redirects (src, dst)."""
    tag = lambda pattern, target: F.regexp_extract(F.regexp_extract(F.coalesce("html", F.lit("")), pattern, 0), target, 1)
    found = pages.select("url", F.explode(F.array(tag(CANONICAL, HREF), tag(REFRESH, TARGET))).alias("to")).where("to <> '' and url is not null")
    base = F.regexp_extract("url", "^(.*?://[^/?#]*)", 1)
    to = F.when(F.contains("to", F.lit("://")), F.col("to")).when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), "to")).when(
        F.startswith("to", F.lit("/")), F.concat(base, "to"))
    links = found.select("url", to.alias("to"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("src").alias("url"), F.col("dst").alias("to")))
    left = _located(links, "url")
    right = _located(left.select(F.col("host").alias("h"), F.col("path").alias("p"), "to"), "to")
    return right.select(F.col("h").alias("host"), F.col("p").alias("path"), F.col("host").alias("to_host"), F.col("path").alias("to_path")).where(
        "host <> '' and to_host <> ''").distinct()


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host, fits no rule, has no alias and is
    allowed.  Null html has no links; repeated rows repeat; other columns are ignored.
    """
    located = _located(pages.select("page_id", "url"), "url").select("page_id", "host", "path")
    links = session.stored(alias_links(pages, redirects), "alias-links")
    ends = links.select("host", "path").unionByName(links.select(F.col("to_host").alias("host"), F.col("to_path").alias("path")))
    nodes = located.select("host", "path").unionByName(ends).distinct()
    ruled = session.stored(judged(nodes, rules).withColumn("node", F.xxhash64("host", "path")), "judged-urls")
    groups = graph.components(links.select(F.xxhash64("host", "path").alias("a"), F.xxhash64("to_host", "to_path").alias("b")))
    blocked = ruled.where("ruled = 'block'").select("node").join(groups, "node").select("component").distinct()
    tainted = groups.join(blocked, "component").select("node", F.lit("block").alias("carried"))
    known = ruled.join(tainted, "node", "left").select("host", "path", "rule", F.coalesce("ruled", "carried", F.lit("allow")).alias("verdict"))
    return located.join(known, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")
