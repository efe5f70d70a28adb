"""URL filter by rules and by link-graph propagation (operator 1), in DataFrame operations only.

Pages link hosts. Trust flows from hosts whose pages the allow rules cover along the links
(personalised PageRank), distrust from hosts under block rules against the links, to those who
point at them. Masses are whole numbers and divisions are exact, so results do not depend on the
order of sums; they are iterated until no mass changes by a whole unit, 1 in 10^12 of all. A host is blocked when its distrust is at least ``threshold`` percent of its trust
and distrust together; a rule that fits a url overrides its host's verdict.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed; hosts
that no propagation reaches are allowed; links to the own host count for nothing; null html has no
links; repeated pages are judged alike; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.sources.shared import stage

#: (verdict, host, path); fixed values of the query's contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

MASS = 10**12
DAMPING = 85
#: Most rounds; masses that still change by a unit then fail the query.
ROUNDS = 1000
#: Rounds planned together before the masses are written out and compared.
ROUNDS_A_TABLE = 3
#: Percent of distrust from which a host is blocked.
THRESHOLD = 50

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*[F.when(fit, F.lit(h + p)) for fit, (_, h, p) in zip(fits, ordered)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fit, F.lit(v)) for fit, (v, _, _) in zip(fits, ordered)], F.lit(None).cast("string"))
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: ``src, dst``."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)),
                                           lambda x: F.translate(x, _UPPER, _LOWER)))
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
        .where("src <> dst AND src <> ''").distinct()
    )


def _total(mass: DataFrame) -> int:
    """The sum of all masses, at most ``2 * MASS``."""
    return mass.agg(F.sum("mass").alias("total")).first().total or 0


def propagate(
    hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS, rounds_a_table: int = ROUNDS_A_TABLE,
) -> DataFrame:
    """Masses per host: ``host, trust, distrust``.

    ``hosts`` has ``host, trust_seed, distrust_seed`` (numbers of pages). Each round keeps 15
    percent of the seeds' mass and moves 85 percent of what a host has, in equal parts, along its
    edges: trust along links, distrust against them. What hosts without edges have is not moved.
    Masses start from what is kept, so they only grow, and equal sums mean that none has changed.
    """
    totals = hosts.agg(F.sum("trust_seed").alias("all_trust"), F.sum("distrust_seed").alias("all_distrust"))
    seeds = hosts.crossJoin(F.broadcast(totals))  # one row of totals
    parts = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.expr(f"coalesce(cast(trust_seed AS decimal(20,0)) * {MASS} div nullif(all_trust, 0), 0)").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), F.expr(f"coalesce(cast(distrust_seed AS decimal(20,0)) * {MASS} div nullif(all_distrust, 0), 0)").alias("seed")),
    ))
    seeds = stage(
        seeds.select("host", parts.alias("p")).select("host", "p.kind", "p.seed").where("seed > 0"), "host-seeds"
    )
    both = edges.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")),
    )).alias("e")).select("e.*")
    degrees = both.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    flow = stage(both.join(degrees, ["kind", "host"]), "host-links")
    kept = seeds.select("host", "kind", F.expr(f"seed * {100 - DAMPING} div 100").alias("mass"))
    mass = stage(kept, "host-mass")
    before = _total(mass)
    for number in range(1, rounds + 1):
        moved = flow.join(mass, ["kind", "host"]).select(
            F.col("to").alias("host"), "kind", F.expr(f"mass * {DAMPING} div (100 * degree)").alias("mass")
        )
        mass = kept.union(moved).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        if number % rounds_a_table == 0 or number == rounds:
            mass = stage(mass, "host-mass")
            now = _total(mass)
            if now == before:
                break
            before = now
    else:
        raise RuntimeError(f"host masses still change after {rounds} rounds")
    return mass.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")]
    )


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD,
) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, trust, distrust``.

    A host seeds trust (distrust) with its number of pages under allow (block) rules; a host may
    seed both, and the threshold decides.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = urls.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("trust_seed"),
        F.count(F.when(F.col("by_rule") == "block", 1)).alias("distrust_seed"),
    )
    masses = propagate(seeds, stage(host_edges(pages), "host-edges"), rounds)
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    blocked = (distrust > 0) & (distrust * 100 >= (trust + distrust) * threshold)
    return judged.join(masses, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
