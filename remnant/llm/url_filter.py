"""URL filters: rules first, then trust and distrust that flow along links between hosts.

Hosts are nodes; an edge counts the pages of one host that link to another.  Trust starts at
hosts whose pages an allow rule names and flows along links (personalised PageRank); distrust
starts at hosts whose pages a block rule names and flows against links, to hosts that point
there.  A page that no rule fits is blocked if its host's distrust is larger than its trust.
Rounds go on until both have settled and reach no further host.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.sources.storage import discard, stored

#: Fixed values: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
TOLERANCE = 1e-10  # summed change of both vectors
#: Rounds after which the change is within TOLERANCE on any graph; only hosts still to be reached take more.
ROUNDS = math.ceil(math.log(TOLERANCE / 4) / math.log(DAMPING))
RATIO = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none; the first of equals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): pages of src that link to dst; links inside a host don't count.

    Links without a scheme and host stay inside, so only those with // are looked at.
    """
    links = pages.select(host(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1),
        lambda u: host(F.regexp_replace(u, r"^[^/]*//", "x://")),
    ))).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust once settled; seeds: host, allowed, blocked (page counts).

    Each seed vector is scaled to sum one.  Mass at hosts without edges is not passed on.  The
    last round changes both vectors by `tolerance` in sum at most and reaches no further host:
    what is reached only grows, so a round that reaches nothing new is the end of that.
    """
    edges, _ = stored(edges, "links")
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    a, b = float(total["a"] or 0) or 1.0, float(total["b"] or 0) or 1.0
    nodes = seeds.select("host", (F.col("allowed") / a).alias("t0"), (F.col("blocked") / b).alias("d0"))
    if edges.isEmpty():
        keep = F.lit(1.0 - damping)
        return nodes.select("host", (keep * F.col("t0")).alias("trust"), (keep * F.col("d0")).alias("distrust"))
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    nodes, node_path = stored(ends.join(nodes, "host", "full").na.fill(0.0, ["t0", "d0"]), "hosts")
    # One row per direction and edge, with the share of what its start passes on.
    forth = edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select(
        F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("ft"), F.lit(0.0).alias("fd"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(
        F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("ft"), (F.col("n") / F.col("all")).alias("fd"))
    flows, flow_path = stored(forth.unionByName(back), "flows")
    state = nodes.select("host", "t0", "d0", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    spark, path_ = seeds.sparkSession, None
    settled = False
    while not settled:
        moved = (
            flows.join(state.select(F.col("host").alias("at"), "trust", "distrust"), "at").groupBy("to")
            .agg(F.sum(F.col("ft") * F.col("trust")).alias("mt"), F.sum(F.col("fd") * F.col("distrust")).alias("md"))
        )
        old = path_
        state, path_ = stored(
            state.join(moved, F.col("host") == F.col("to"), "left").select(
                "host", "t0", "d0", F.col("trust").alias("_t"), F.col("distrust").alias("_d"),
                ((1 - damping) * F.col("t0") + damping * F.coalesce("mt", F.lit(0.0))).alias("trust"),
                ((1 - damping) * F.col("d0") + damping * F.coalesce("md", F.lit(0.0))).alias("distrust"),
            ),
            "hosts",
        )
        reached = ((F.col("trust") > 0) & (F.col("_t") == 0)) | ((F.col("distrust") > 0) & (F.col("_d") == 0))
        change, further = state.agg(
            F.sum(F.abs(F.col("trust") - F.col("_t")) + F.abs(F.col("distrust") - F.col("_d"))), F.count(F.when(reached, 1))
        ).first()
        settled = not further and (change or 0.0) <= tolerance
        if old:
            discard(spark, old)
    discard(spark, flow_path)
    discard(spark, node_path)
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per row of pages.

    A null url, or one without ://, has an empty host and path; no rule fits an empty host, and
    it is allowed, as is every host that neither trust nor distrust reaches.  Rows that repeat an
    id are judged each.  Null html has no links.  Other columns are ignored.
    """
    rows = pages.select(F.col(page_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    seeds, _ = stored(
        rows.filter("host <> ''").groupBy("host").agg(
            F.count(F.when(F.col("_r")["verdict"] == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("_r")["verdict"] == "block", 1)).alias("blocked"),
        ),
        "seeds",
    )
    scores, _ = stored(propagate(seeds, host_edges(pages, url_col, html_col)), "scores")
    out = rows.join(scores, "host", "left")
    by_host = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("_r")["rule"].alias("rule"),
        F.coalesce(F.col("_r")["verdict"], by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
