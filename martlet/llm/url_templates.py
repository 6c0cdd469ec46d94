"""URL filter by a tree of path templates per host.

Paths are cut into segments, and each host's paths form a tree that is
generalised level by level from the root:

1. a segment stays as it is if it holds at least ``LEAST_SHARE`` of its
   parent's pages (and ``LEAST_PAGES``); otherwise it becomes its shape, with
   runs of digits as ``#`` if it has any, else ``*``;
2. branches of one parent whose share of good labels can't be told from that
   of all of them together (within ``DEVIATION`` standard deviations) merge
   into the branch ``~``; a branch without labels can't be told either.

The first ``DEPTH`` levels always add to the template. Deeper ones are walked
the same way as far as paths go, but add to the templates below a branch only
where labels tell its branches apart. A branch whose labels can't differ enough
for that (``_can_split``) ends there, which changes no result. A template is rejected when
its purity, the share of good labels smoothed towards its host's (itself
smoothed towards that of all pages), is below ``LEAST_PURITY``. Fixed rules
for hosts and path beginnings come first; the longest fitting rule decides.

Scale: everything runs on distinct (host, path) rows without the pages' html;
a level is two aggregations on (host, branch) and joins back on
(host, branch, segment), so one host with a third of all pages still spreads
by segment and combines on the map side.

Defined cases: a null url, or one without ``://``, has empty host and path;
an empty path has one empty segment; hosts without labels have the purity of
all pages, and without any label that is 1. Labels other than 0 and 1 count as
none. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import materialise

DEPTH = 4
LEAST_SHARE = 0.05
LEAST_PAGES = 3
DEVIATION = 2.0
TEMPLATE_WEIGHT = 10.0
HOST_WEIGHT = 20.0
LEAST_PURITY = 0.5
#: (verdict, host, beginning of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as ``host + path`` and its verdict (null if
    none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _shape(segment: Column) -> Column:
    return F.when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "#")).otherwise(F.lit("*"))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/", -1)


def _can_split(labelled: Column, good: Column, deviation: float) -> Column:
    """Whether some part of so many labels can differ from all of them: the
    part that differs most is all the good ones, or all the others."""
    bad = labelled - good
    return (good > 0) & (bad > 0) & (F.greatest(good, bad) > F.lit(deviation * deviation))


def _sums(*more: Column) -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), *more]


def templates(paths: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE,
              least_pages: int = LEAST_PAGES, deviation: float = DEVIATION) -> DataFrame:
    """``host, path, template`` and the counts of ``paths(host, path, n,
    labelled, good)``."""
    state = materialise(paths.withColumn("segments", _segments(F.col("path"))).withColumn("branch", F.lit("")), "paths")
    done, level = None, 0
    while True:
        if level >= depth:  # only branches that can still split go on
            more = state.where(F.size("segments") > level)
            can = more.groupBy("host", "branch").agg(*_sums()).where(
                _can_split(F.col("labelled"), F.col("good"), deviation)).select("host", "branch")
            can = materialise(can.withColumn("goes_on", F.lit(True)), "going")
            marked = state.join(can, ["host", "branch"], "left")
            goes_on = F.col("goes_on").isNotNull() & (F.size("segments") > level)
            ended = marked.where(~goes_on).drop("goes_on", "segments")
            done = ended if done is None else done.unionByName(ended)
            state = marked.where(goes_on).drop("goes_on")
            if can.isEmpty():
                break
        segment = F.when(F.size("segments") > level, F.get("segments", F.lit(level)))
        here = state.withColumn("segment", segment)
        open_ = here.where("segment IS NOT NULL")
        nodes = open_.groupBy("host", "branch", "segment").agg(*_sums())
        parents = nodes.groupBy("host", "branch").agg(F.sum("n").alias("pages"))
        stays = ((F.col("n") >= least_share * F.col("pages")) & (F.col("n") >= least_pages)) | (F.col("segment") == "")
        nodes = nodes.join(parents, ["host", "branch"]).withColumn(
            "general", F.when(stays, F.col("segment")).otherwise(_shape(F.col("segment")))).drop("pages")
        branches = nodes.groupBy("host", "branch", "general").agg(*_sums())
        pooled = branches.groupBy("host", "branch").agg(
            F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
        share = F.coalesce(F.try_divide(F.col("all_good").cast("double"), F.col("all_labelled")), F.lit(1.0))
        off = F.abs(F.col("good") - F.col("labelled") * share)
        similar = off * off <= F.lit(deviation * deviation) * F.col("labelled") * share * (1 - share)
        merged = branches.join(pooled, ["host", "branch"]).select(
            "host", "branch", "general", F.when(similar, F.lit("~")).otherwise(F.col("general")).alias("next"))
        if level >= depth:
            apart = merged.groupBy("host", "branch").agg(F.bool_or(F.col("next") != "~").alias("apart"))
            merged = merged.join(apart, ["host", "branch"]).where("apart").drop("apart")
        step = nodes.join(merged, ["host", "branch", "general"]).select(
            "host", "branch", "segment", F.concat("branch", F.lit("/"), "next").alias("longer"))
        moved = here.join(step, ["host", "branch", "segment"], "left")
        state = materialise(moved.withColumn("branch", F.coalesce("longer", "branch")).drop("segment", "longer"), "level")
        level += 1
    state = materialise(done, "templates")
    return state.select("host", "path", "n", "labelled", "good", F.col("branch").alias("template"))


def purities(found: DataFrame, template_weight: float = TEMPLATE_WEIGHT, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """``host, template, purity`` of ``templates`` rows."""
    per = found.groupBy("host", "template").agg(*_sums())
    hosts = per.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    every = hosts.agg(F.sum("host_labelled").alias("l"), F.sum("host_good").alias("g")).first()
    overall = every["g"] / every["l"] if every["l"] else 1.0
    of_host = ((F.col("host_good") + F.lit(host_weight * overall)) / (F.col("host_labelled") + F.lit(host_weight)))
    purity = (F.col("good") + F.lit(template_weight) * of_host) / (F.col("labelled") + F.lit(template_weight))
    return per.join(hosts, "host").select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES, least_purity: float = LEAST_PURITY, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of
    ``pages(page_id, url, label)``; a label is 1 (good), 0 or null."""
    rows = materialise(pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                                    F.when(F.col("label").isin(0, 1), F.col("label")).alias("label")), "urls")
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("good"))
    found = templates(paths, **options)
    pure = purities(found)
    of_path = found.join(pure, ["host", "template"]).select("host", "path", "template", "purity")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("purity") < least_purity, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(of_path, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"),
        "template", "purity")
