"""URL filters by link-graph propagation, in DataFrame functions only.

Explicit rules (host suffix, path prefix) decide first; the longest wins. Other pages take their host's verdict: trust
spreads from hosts that allow rules name along links, distrust from hosts that block rules name against them (a page that
links to a bad host is suspect). Both are personalised PageRanks over distinct host pairs, iterated until no further
host is reached and no rank moves by more than TOLERANCE of itself; a host is blocked if its distrust is at least
`threshold` of the two together. A host with neither is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; ties by host, then path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from absolute and protocol-relative links. Pre-aggregated by host pair."""
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1)))
    rows = pages.filter("html is not null and host <> ''").select(F.col("host").alias("src"), link.alias("to")).withColumn("dst", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))))
    return rows.filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust at rest. seeds: host, trust, distrust (restart weights). Mass of hosts without links is lost, not spread.

    What both joins of a step read was cut before, so that Spark can split the task of a host with very many links.
    """
    start = cut(seeds.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    if edges.isEmpty():
        return start
    out, back = (cut(edges.groupBy(c).agg(F.sum("n").alias(n))) for c, n in (("src", "n_out"), ("dst", "n_in")))
    half = cut(edges.join(out, "src"))
    e = cut(half.join(back, "dst").select("src", "dst", (F.col("n") / F.col("n_out")).alias("f"), (F.col("n") / F.col("n_in")).alias("b")))
    forget(out, back, half)
    zero, names = F.lit(0.0), ("trust", "distrust", "was_trust", "was_distrust")
    restart = start.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"), zero.alias("was_trust"), zero.alias("was_distrust"))
    rank = start
    while True:
        forward = e.join(rank.select(F.col("host").alias("src"), "trust").filter("trust > 0"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("f") * damping).alias("trust"), zero.alias("distrust"), zero.alias("was_trust"), zero.alias("was_distrust"))
        against = e.join(rank.select(F.col("host").alias("dst"), "distrust").filter("distrust > 0"), "dst").select(F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("b") * damping).alias("distrust"), zero.alias("was_trust"), zero.alias("was_distrust"))
        was = rank.select("host", zero.alias("trust"), zero.alias("distrust"), F.col("trust").alias("was_trust"), F.col("distrust").alias("was_distrust"))
        new = cut(restart.unionByName(forward).unionByName(against).unionByName(was).groupBy("host").agg(*(F.sum(c).alias(c) for c in names)))
        forget(rank) if rank is not start else None
        rank = new.select("host", "trust", "distrust")
        moved = F.greatest(*(F.abs(F.col(c) - F.col(f"was_{c}")) - tolerance * F.col(c) for c in names[:2])) > 0
        if new.filter(moved).isEmpty():
            forget(e)
            return rank


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    Seeds: hosts of which block rules decide at least half of the pages are distrusted, others that an allow rule names are trusted, each by
    that share of its pages, and each side scaled to sum to one.
    Null urls and those without :// have empty host and path, fit no rule and are allowed. Null html has no links. Repeated rows repeat and
    weigh as pages of their own. An empty table gives an empty result. Other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    share = lambda v: F.avg((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("double"))
    bad = F.col("distrust") >= 0.5
    hosts = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = cut(hosts.select("host", F.when(bad, 0.0).otherwise(F.col("trust")).alias("trust"), F.when(bad, F.col("distrust")).otherwise(0.0).alias("distrust")))
    total = hosts.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    scale = lambda c, s: (F.col(c) / F.lit(float(s))) if s else F.lit(0.0)
    seeds = hosts.select("host", scale("trust", total.t).alias("trust"), scale("distrust", total.d).alias("distrust"))
    ranks = propagate(cut(host_edges(rows)), seeds)
    both = F.coalesce(F.col("trust"), F.lit(0.0)) + F.coalesce(F.col("distrust"), F.lit(0.0))
    said = F.when((both > 0) & (F.col("distrust") >= F.lit(threshold) * both), "block").otherwise("allow")
    return ruled.join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark, sf_dir):
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
