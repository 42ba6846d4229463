"""URL verdicts by rules, and by trust that flows over links between hosts.

Rules are lists of (verdict, host, path): a rule fits its host and all subdomains if the path begins with the rule's; of
those that fit the longest decides. Hosts whose ruled pages are allowed are seeds of trust, those whose pages are blocked
are seeds of distrust, each with the share of such pages among all of the host. Personalised PageRank spreads trust along
the links and distrust against them, from linked to linking host, until next to nothing is left to move. A page that no rule decides is blocked if distrust makes
up at least a set part of trust, distrust and the share of pages without a rule of its host, and allowed otherwise.

Results for odd rows: a null url or one without ``://`` has empty host and path, no rule and the verdict allow; null or
empty html has no links; repeated rows are judged alike and their links count once per host pair; further columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import ascii_lower, saved

Rule = tuple[str, str, str]
#: Fixed values of the contract: (verdict, host, path).
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Weight still on its way, as a share of that of all seeds, at which propagation ends.
TOLERANCE = 1e-3
DISTRUST_SHARE = 0.75
#: Link targets with a host, also those that leave the scheme to the page.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null. Meant for lists of up to some hundred rules."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    return F.coalesce(*[
        F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix)),
               F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, name, prefix in longest_first],
        F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct rows (src, dst) of different hosts; relative links stay on their host and need no row."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    whole = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return (found.select("src", host_of(whole).alias("dst"))
            .where("src <> '' AND dst <> '' AND src <> dst").distinct())


def spread(seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Rows (kind, host, score) of personalised PageRank.

    ``seeds`` has (kind, host, seed), ``links`` has (kind, src, dst); the kinds are graphs beside each other. Score is
    the host's seed and the damped share of the scores that link to it; it is not normalised, so the kinds can be compared.
    Each round moves only what arrived in the round before, and ends when less than ``tolerance`` of the seeds' weight is
    on its way: each score is then exact but for that weight times damping / (1 - damping).
    """
    out = links.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    links = saved(links.join(out, ["kind", "src"]), "links")
    moving = seeds.select("kind", "host", F.col("seed").alias("score"))
    if links.isEmpty():
        return moving
    moving = saved(moving, "scores")
    parts, whole = [moving], moving.agg(F.sum("score")).first()[0] or 0.0
    left = whole
    while left > tolerance * whole:
        moved = (links.join(moving.withColumnRenamed("host", "src"), ["kind", "src"])
                 .select("kind", F.col("dst").alias("host"), (damping * F.col("score") / F.col("degree")).alias("score")))
        moving = saved(moved.groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
        left = moving.agg(F.sum("score")).first()[0] or 0.0
        parts.append(moving)
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, distrust_share: float = DISTRUST_SHARE) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust) of every page."""
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = found.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    given = F.col("fit.verdict")
    shares = saved(ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.coalesce((given == "allow").cast("double"), F.lit(0.0))).alias("trust"),
        F.avg(F.coalesce((given == "block").cast("double"), F.lit(0.0))).alias("distrust"),
        F.avg(given.isNull().cast("double")).alias("open")), "host-shares")
    seeds = shares.select("host", F.explode(F.create_map(
        F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed")).where("seed > 0")
    links = saved(host_links(pages), "host-links")
    both = reduce(DataFrame.unionByName, [
        links.select(F.lit("trust").alias("kind"), "src", "dst"),
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))])
    scores = (spread(seeds, both).groupBy("host")
              .agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
                   F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
              .join(shares.select("host", "open"), "host", "left"))
    bad = F.coalesce(F.col("distrust"), F.lit(0.0))
    good = F.coalesce(F.col("trust"), F.lit(0.0))
    method = F.when((bad > 0) & (bad >= distrust_share * (bad + good + F.coalesce(F.col("open"), F.lit(0.0)))), "block").otherwise("allow")
    return (ruled.join(scores, "host", "left")
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce(F.col("fit.verdict"), method).alias("verdict"), good.alias("trust"), bad.alias("distrust")))
