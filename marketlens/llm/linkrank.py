"""Host verdicts by trust and distrust that propagate over host edges.

Trust starts at hosts with pages that an allow rule fits and follows the edges; distrust
starts at hosts with pages that a block rule fits and goes against them. Both are
personalised PageRank: rank = (1 - d) * seed + d * (what the neighbours pass on). Mass that
reaches a host without edges is not sent back, which only scales the whole channel; ranks are
divided by the channel's total at the end. A host is blocked when distrust makes up more than
`threshold` of its trust plus distrust.

Edges are links to other hosts in the html, weighted by their number, and one edge each way
between a host and its parent domain, so that sites of one owner inform each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import lower_ascii, stored, table

#: Fixed values: (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
DAMPING = 0.85
ROUNDS = 16
#: Rounds between two stored rank tables.
STRIDE = 4
THRESHOLD = 0.5
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, linked hosts): all that later steps need, without the html."""
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii)
    return pages.select("page_id", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"),
                        F.coalesce(links, F.array().cast("array<string>")).alias("links"))


def apply_rules(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """`parsed` with `rule` and `ruled`, the verdict of the longest rule that fits, or nulls.

    Rules meet the distinct hosts by equality on host suffixes, whatever their number.
    """
    suffix = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(
        F.slice("labels", i, F.size("labels")), "."))
    fitting = (parsed.select("host").distinct().where("host <> ''")
               .withColumn("labels", F.split("host", r"\."))
               .select("host", F.explode(suffix).alias("rule_host"))
               .join(rules.toDF("rule_host", "rule_path", "ruled"), "rule_host")
               .withColumn("rule", F.concat("rule_host", "rule_path"))
               .groupBy("host").agg(F.collect_list(F.struct(
                   F.length("rule").alias("n"), "rule", "rule_path", "ruled")).alias("fit")))
    best = F.array_max(F.filter("fit", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return (parsed.join(fitting, "host", "left").withColumn("best", best)
            .withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")})
            .drop("fit", "best"))


def host_edges(parsed: DataFrame, parent_weight: float = 1.0) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    links = (parsed.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
             .where("src <> dst AND src <> ''").groupBy("src", "dst")
             .agg(F.count("*").cast("double").alias("weight")))
    chain = F.split("host", r"\.")
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.size(chain)), lambda i: F.struct(
        F.array_join(F.slice(chain, i, F.size(chain)), ".").alias("src"),
        F.array_join(F.slice(chain, i + 1, F.size(chain)), ".").alias("dst"))),
        lambda s: F.contains(s["dst"], F.lit(".")))
    hosts = parsed.select("host").union(links.select("dst")).distinct().where("host <> ''")
    up = hosts.select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct()
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (links.union(both.withColumn("weight", F.lit(parent_weight)))
            .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS,
              damping: float = DAMPING) -> DataFrame:
    """(channel, host, rank) after `rounds` rounds from seeds (channel, host, seed).

    Channel `trust` follows the edges, `distrust` goes against them.
    """
    ways = (edges.select(F.lit("trust").alias("channel"), "src", "dst", "weight")
            .union(edges.select(F.lit("distrust"), "dst", "src", "weight")))
    out = ways.groupBy("channel", "src").agg(F.sum("weight").alias("total"))
    shares = stored(ways.join(out, ["channel", "src"]).select(
        "channel", F.col("src").alias("host"), "dst",
        (F.col("weight") / F.col("total") * damping).alias("share")), "host-edges")
    base = seeds.select("channel", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    ranks = seeds.select("channel", "host", F.col("seed").alias("rank"))
    for i in range(1, rounds + 1):
        passed = ranks.join(shares, ["channel", "host"]).select(
            "channel", F.col("dst").alias("host"),
            (F.col("rank") * F.col("share")).alias("rank"))
        ranks = (base.union(passed).groupBy("channel", "host")
                 .agg(F.sum("rank").alias("rank")))
        if i % STRIDE == 0 or i == rounds:
            ranks = stored(ranks, "host-ranks")
    return ranks


def host_verdicts(ruled: DataFrame, edges: DataFrame, rounds: int = ROUNDS,
                  damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, host_verdict) of every host that a seed reaches.

    A host's seed is the share of its pages that a rule of that kind fits, so that a host
    with a third of all pages weighs no more than another. Ratios are rounded to nine digits
    before they meet the threshold: the order of a sum then cannot change a verdict.
    """
    share = {c: F.sum(F.col("ruled").eqNullSafe(v).cast("int")) / F.count("*")
             for c, v in (("trust", "allow"), ("distrust", "block"))}
    seeds = (ruled.where("host <> ''").groupBy("host").agg(
        F.create_map(*(x for c in share for x in (F.lit(c), share[c]))).alias("seed"))
        .select("host", F.explode("seed").alias("channel", "seed")).where("seed > 0"))
    ranks = propagate(edges, stored(seeds, "host-seeds"), rounds, damping)
    totals = {r["channel"]: r["t"] for r in
              ranks.groupBy("channel").agg(F.sum("rank").alias("t")).collect()}
    part = {c: F.sum(F.when(F.col("channel") == c, F.col("rank")).otherwise(0.0))
            / totals.get(c, 1.0) for c in ("trust", "distrust")}
    bad = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    return (ranks.groupBy("host").agg(*(v.alias(k) for k, v in part.items()))
            .withColumn("host_verdict", F.when(bad > threshold, "block").otherwise("allow")))


def judge_urls(pages: DataFrame, rules: DataFrame, **options: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of `pages`.

    Columns beyond page_id, url and html are not read. A null url or one without `://` has an
    empty host and path, fits no rule and is allowed, as is a host that no seed reaches. Null
    html has no links; repeated rows are judged each; an empty table gives no rows.
    """
    parsed = stored(parse_pages(pages), "url-parts")
    # Stored, so that the join by host stands alone and a hot host's rows can be split.
    ruled = stored(apply_rules(parsed.drop("links"), rules), "url-rules")
    verdicts = host_verdicts(ruled, host_edges(parsed), **options)
    return (ruled.join(verdicts, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"),
                    F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
        for h, p, v in rules))))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark)).select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")
