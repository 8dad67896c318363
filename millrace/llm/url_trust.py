"""URL filtering: rules first, then trust and distrust propagated over host links.

Rules are (host, path prefix) pairs; the longest that fits a url decides.  For the rest, two
personalised PageRanks run over the host graph.  Trust flows along links from hosts by the share of
their pages that rules allow; a host divides its trust among its links.  Distrust flows against
links from hosts by the share that rules block; a linker takes the mean distrust over its own
links, weighted by the share of its pages that no rule blocks, so one bad link among many good ones
counts for little and the number of other linkers for nothing.  That makes distrust the chance that
a reader who starts on the host and follows links with chance ``damping`` meets a blocked page.
Both ranks count a host's own share once, with links or without.  A host is blocked when its
distrust is at least ``threshold`` and above its trust.  Pages and links are summed per host on the
map side; only host tables take part in the iteration, which ends when no rank moves by more than
one in 100,000, after some 80 rounds at most, however long the chains of links are.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed unless distrust reaches the empty host; null html has no links; links that are relative or
lead to the own host carry no vote; repeated rows count each in their host's shares and links, and
each get their row; hosts whose distrust equals their trust are allowed; html of any length is
searched whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.  rules: (verdict, host, path).

    The rules are a short list that the caller writes down; they become one expression.
    """
    hit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        hit = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, links) between different hosts, from the anchors of ``html``."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), 1)
    outward = F.filter(links, lambda x: x.contains("://") | x.startswith("//"))
    return (
        pages.select(F.col(host).alias("src"), F.explode(outward).alias("link"))
        .select("src", url_host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
        .where("dst != '' and dst != src")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def personalised_rank(
    seeds: DataFrame,
    edges: DataFrame,
    damping: float = 0.85,
    rounds: int = 30,
    tolerance: float = 1e-6,
    settle: bool = False,
    floor: float = 0.0,
) -> DataFrame:
    """(host, rank): the fixed point of ``rank = (1-d) * seed + d * inflow``; hosts that nobody
    links to keep their seed.  seeds: (host, seed); edges: (src, dst, links), where each host divides
    its rank among its links, or (src, dst, share) with the shares that flow.

    Stops when no rank moves by more than ``tolerance`` or after ``rounds``; each round is written
    to the shared scratch folder, so that neither the plan nor a lost executor's work grows.

    With ``settle`` the formula holds for hosts that nobody links to as well, and rounds go on, as
    many as it takes, until no rank moves by more than ``tolerance`` times itself, moves of at most
    ``floor`` aside.  Tables of past rounds are deleted.
    """
    if "share" in edges.columns:
        shares = edges.select("src", "dst", "share")
    else:
        out_links = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
        shares = edges.join(out_links, "src").select("src", "dst", (F.col("links") / F.col("out_links")).alias("share"))
    weights = materialize(shares, "edges")
    linked = weights.select(F.col("dst").alias("host")).distinct().withColumn("linked", F.lit(True))
    base = materialize(seeds.join(linked, "host", "left").select("host", "seed", F.coalesce("linked", F.lit(settle)).alias("linked")), "seeds")
    # with settle, ranks grow from below: a host that no seed reaches stays at exactly 0
    rank = base.select("host", ((1 - damping) * F.col("seed") if settle else F.col("seed")).alias("rank"))
    if weights.isEmpty():
        return rank
    last = None
    for _ in itertools.count() if settle else range(rounds):
        inflow = (
            weights.join(rank, F.col("src") == F.col("host"))
            .groupBy("dst")
            .agg(F.sum(F.col("share") * F.col("rank")).alias("inflow"))
        )
        moved = (
            base.join(inflow, F.col("host") == F.col("dst"), "left")
            .join(rank.withColumnRenamed("rank", "old"), "host")
            .select(
                "host",
                F.when(F.col("linked"), (1 - damping) * F.col("seed") + damping * F.coalesce("inflow", F.lit(0.0)))
                .otherwise(F.col("seed"))
                .alias("rank"),
                "old",
            )
        )
        moved = materialize(moved, "rank")
        change = F.abs(F.col("rank") - F.col("old"))
        step = moved.agg(F.max(F.when((F.col("rank") > 0) & (change > floor), change / F.col("rank")) if settle else change)).first()[0]
        rank = moved.select("host", "rank")
        if last is not None:
            discard(last)
        last = moved
        if step is None or step <= tolerance:
            break
    return rank


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.5,
    damping: float = 0.85,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    seen = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
        F.col(html_col).alias("html"),
    ).withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("hit.verdict") == verdict, 1.0).otherwise(0.0))
    on_page = seen.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    edges = materialize(host_edges(seen, "host", "html"), "host-edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = materialize(
        on_page.join(ends, "host", "full_outer").select("host", F.coalesce("allowed", F.lit(0.0)).alias("allowed"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")),
        "hosts",
    )
    settled = {"damping": damping, "settle": True, "floor": 1e-5 * (1 - damping)}
    own = 1 - damping  # the weight of a host's own share inside a rank
    trust = personalised_rank(hosts.select("host", F.col("allowed").alias("seed")), edges, **settled)
    out_links = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
    against = (
        edges.join(out_links, "src")
        .join(hosts.select(F.col("host").alias("src"), "blocked"), "src")
        .select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("out_links") * (1 - F.col("blocked"))).alias("share"))
    )
    distrust = personalised_rank(hosts.select("host", F.col("blocked").alias("seed")), against, **settled)
    judged = (
        trust.select("host", (F.col("rank") / own).alias("trust"))
        .join(distrust.select("host", (F.col("rank") / own).alias("distrust")), "host")
        .withColumn("host_verdict", F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))
    )
    return (
        seen.drop("html")
        .join(judged, "host")
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", "host_verdict").alias("verdict"), "trust", "distrust",
        )
    )
