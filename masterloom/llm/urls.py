"""URL filtering by rules and by trust that flows along links.

Rules decide the pages they fit. The other pages are judged by their host: trust
starts at hosts with allowed pages and follows links, distrust starts at hosts
with blocked pages and runs against them (who links to bad hosts is suspect), both
as personalised PageRank on the graph of hosts. A host is blocked if distrust is
more than ``threshold`` of both together; a host that neither reaches is allowed.

Defined cases: a null url, or one without ``://``, has empty host and path and fits
no rule; null html has no links; repeated rows and links count once per page row
and once per host pair; hosts known only from links take part in the graph but give
no rows; links to the own host are left out; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import own_columns

DAMPING = 0.85
ROUNDS = 20
THRESHOLD = 0.5
# A link in a page to another host, by its full or protocol-relative address.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where there is no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(_lower_ascii(host), empty), F.coalesce(path, empty)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, allow); null if none does.

    The list is part of the plan: it is a parameter of a few rules, not a table.
    """
    fits = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the last test made is the first in force
        test = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fits = F.when(test, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(fits)
    return fits


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of links between different hosts, once per pair.

    Links are made distinct within a page before they are exploded, and pairs are
    combined before the shuffle.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), _lower_ascii))
    return (
        pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
        .where("src <> dst AND dst <> ''").distinct())


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds from ``seeds``
    (host, good, bad) over ``links`` (src, dst), a written table.

    Trust is shared over the links out of a host, distrust over those into it.
    Every round is one join of links and scores in each direction and one
    aggregate; every fifth is written, which bounds the plan and what a lost
    executor costs.
    """
    scores = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    if links.isEmpty():
        return scores.withColumns({c: F.col(c) * (1 - damping) for c in ("trust", "distrust")})
    out = links.groupBy("src").agg(F.count("*").alias("n_out"))
    into = links.groupBy("dst").agg(F.count("*").alias("n_in"))
    edges = written(links.join(out, "src").join(into, "dst"), "url-edges")
    base = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    base = written(base, "url-seeds")
    for i in range(1, rounds + 1):
        forward = edges.join(scores, edges.src == scores.host).select(
            F.col("dst").alias("host"), (F.col("trust") * damping / F.col("n_out")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(scores, edges.dst == scores.host).select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * damping / F.col("n_in")).alias("distrust"))
        scores = base.unionByName(forward).unionByName(back).groupBy("host").agg(
            F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % 5 == 0 or i == rounds:
            scores = written(scores, f"url-round-{i}")
    return scores


def judge_urls(pages: DataFrame, rules: Sequence[Rule], damping: float = DAMPING, rounds: int = ROUNDS,
               threshold: float = THRESHOLD) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = split_url(F.col("url").cast("string"))
    read = own_columns(pages, "page_id", "url", "html")
    parts = read.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    links = written(host_links(parts), "url-links")
    # Without html the scan reads the urls only.
    judged = parts.drop("html").withColumn("_fit", fit)
    seeds = judged.where("host <> '' AND _fit IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("_fit.allow")).cast("double").alias("good"),
        F.count_if(~F.col("_fit.allow")).cast("double").alias("bad"))
    scores = written(propagate(seeds, links, damping, rounds), "url-scores")
    scored = judged.join(scores.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    spoilt = distrust > (trust + distrust) * threshold
    allowed = F.when(F.col("_fit").isNotNull(), F.col("_fit.allow")).otherwise(~spoilt)
    return scored.select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"),
        F.when(allowed, "allow").otherwise("block").alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
