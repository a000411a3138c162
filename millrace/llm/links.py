"""URL filters [native]: rules first, then trust and distrust propagated over the host link graph.

Two personalised PageRanks run over host edges: trust starts at hosts that rules allow and follows links, distrust
starts at hosts that rules block (or whose labels hold a blocked term) and follows links backwards. A host whose
share of distrust exceeds the threshold is blocked. Both ranks are scaled to a sum of one: mass that reaches a host
without links is lost in each iteration, and giving it back to the seeds would change the fixed point by a factor only.
Edges are summed per host pair before the first iteration, so the graph is as large as the number of linked host pairs,
not the number of links; ranks live in tables written to the shared folder every few iterations, which go on until a
rank hardly changes.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; repeated
pages are judged separately; null html has no links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Fixed values: (verdict, host, path) in the order in which they are given.
DEFAULT_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words between the dots and hyphens of host names that mark a seed of distrust.
BLOCKED_TERMS = ("adult", "bets", "casino", "gambling", "pills", "porn", "viagra", "warez", "xxx")

#: Up to so many rules travel as a literal with each row; more are joined by host suffix.
LITERAL_RULES = 500


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    iterations: int = 60
    keep_every: int = 6
    tolerance: float = 0.001
    block_share: float = 0.5
    least_distrust: float = 0.02


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _literal_match(host: Column, path: Column, rules: tuple) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), or null."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        name = rule_host + rule_path
        fits.append(
            F.when(
                ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path),
                F.struct(F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict")),
            )
        )
    return F.sort_array(F.filter(F.array(*fits), lambda x: x.isNotNull()), asc=False)


def apply_rules(pages: DataFrame, rules: tuple = DEFAULT_RULES) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule and rule_verdict. Equal lengths: the greater name wins."""
    placed = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    if len(rules) <= LITERAL_RULES:
        best = F.get(_literal_match(F.col("host"), F.col("path"), rules), F.lit(0)) if rules else F.lit(None)
        if not rules:
            return placed.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
        return placed.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "_host string, _path string, _rule string, _verdict string")
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = placed.select("host", "path").distinct()
    found = (
        keys.withColumn("_host", F.explode(suffixes))
        .join(table, "_host")
        .filter(F.col("path").startswith(F.col("_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("_rule").alias("size"), F.col("_rule"), F.col("_verdict"))).alias("_best"))
    )
    return placed.join(found, ["host", "path"], "left").withColumns({"rule": F.col("_best._rule"), "rule_verdict": F.col("_best._verdict")}).drop("_best")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many absolute links the pages of one host hold to another host."""
    targets = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'<>]+)"), 1)
    return (
        pages.select(url_host(F.col("url")).alias("src"), F.explode(targets).alias("link"))
        .select("src", url_host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
        .filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def _sum(df: DataFrame, value: Column) -> float:
    return df.agg(F.sum(value)).first()[0] or 0.0


def personalised_rank(edges: DataFrame, seeds: DataFrame, conf: Propagation, scratch: Scratch) -> DataFrame:
    """(host, rank): mass starts at ``seeds`` (host, mass), follows ``edges`` and returns to the seeds; ranks add up to one.

    Each iteration is one join by source host and one sum by target host. Every ``keep_every`` iterations the ranks are
    written, and the change since the last time is compared with the tolerance.
    """
    shares = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("_total")), "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("share"))
    shares = scratch.keep(shares, "shares")
    base = seeds.select("host", (F.col("mass") * (1 - conf.damping)).alias("rank"))
    rank = kept = base
    total = _sum(base, F.col("rank"))
    for step in range(1, conf.iterations + 1):
        passed = rank.join(shares, rank["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * conf.damping).alias("rank"))
        rank = base.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % conf.keep_every == 0 or step == conf.iterations:
            rank = scratch.keep(rank, "rank")
            both = rank.join(kept.withColumnRenamed("rank", "before"), "host", "full").na.fill(0.0, ["rank", "before"])
            changed, total, kept = _sum(both, F.abs(F.col("rank") - F.col("before"))), _sum(rank, F.col("rank")), rank
            if changed <= conf.tolerance * total:
                break
    return rank.withColumn("rank", F.col("rank") / F.lit(total or 1.0))


def host_verdicts(ruled: DataFrame, edges: DataFrame, scratch: Scratch, conf: Propagation = Propagation(), blocked_terms: tuple = BLOCKED_TERMS) -> DataFrame:
    """(host, trust, distrust, host_verdict) for every host that rules, terms or links reach."""
    term = r"(^|[.-])(" + "|".join(blocked_terms) + r")([.-]|$)"
    seen = ruled.filter(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("rule_verdict") == "allow", 1).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("blocked"),
    )
    seen = scratch.keep(seen.withColumn("marked", F.col("host").rlike(term)), "hosts")

    def seeds(good: bool) -> tuple[DataFrame, float]:
        mass = F.when(F.col("marked"), F.lit(0.0 if good else 1.0)).otherwise((F.col("allowed") if good else F.col("blocked")) / F.col("n"))
        raw = seen.select("host", mass.alias("mass")).filter(F.col("mass") > 0)
        total = _sum(raw, F.col("mass"))
        return scratch.keep(raw.withColumn("mass", F.col("mass") / F.lit(total or 1.0)), "seeds"), total

    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    (trusted, all_trust), (blocked, all_distrust) = seeds(True), seeds(False)
    trust = personalised_rank(edges, trusted, conf, scratch).select("host", F.col("rank").alias("trust"))
    distrust = personalised_rank(backwards, blocked, conf, scratch).select("host", F.col("rank").alias("distrust"))
    both = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    # in units of one seed, so that a host's verdict does not turn with the number of seeds elsewhere
    good, ill = F.col("trust") * all_trust, F.col("distrust") * all_distrust
    bad = (ill >= conf.least_distrust) & (ill > conf.block_share * (good + ill))
    return both.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: tuple = DEFAULT_RULES, conf: Propagation = Propagation(), blocked_terms: tuple = BLOCKED_TERMS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's trust and distrust (null if unreached)."""
    ruled = apply_rules(pages.select("page_id", "url"), rules)
    with Scratch(pages.sparkSession) as scratch:
        edges = scratch.keep(host_edges(pages.select("url", "html")), "edges")
        hosts = scratch.result(host_verdicts(ruled, edges, scratch, conf, blocked_terms), "verdicts")
    return ruled.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        "trust",
        "distrust",
    )
