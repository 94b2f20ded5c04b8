"""URL verdicts from rules and, where no rule fits, from trust and distrust that spread over links between hosts.

Only DataFrame functions: no Python runs on the executors. Hosts and links are tables; nothing about them comes
to the driver, and nothing is broadcast but the rules, which a caller gives as a short list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import Scratch


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The share of rank that follows links; steps go on until ranks change by less than TOLERANCE of all rank, within 130 steps whatever the links.
DAMPING, TOLERANCE = 0.85, 1e-9
#: Steps between writes, which cut the lineage and show the change.
CUT_EVERY = 5
#: Steps of the SQL form.
STEPS = 64


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones the first in alphabetical order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts from the href attributes of (host, html). A link without a host of its own stays on its host."""
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)"""), F.lit(1)))
    links = pages.where("host <> ''").select("host", href.alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    dst = F.when(full.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), host_of(full)).otherwise(F.col("host"))
    return links.select(F.col("host").alias("src"), dst.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Personalised PageRank: (host, rank) from seeds (host, seed) over links (src, dst, share); all ranks sum to 1.

    Rank at a host without links goes back to the seeds. That is the walk in which it goes nowhere, but for a factor of all
    ranks, which the sum takes out at the end, as it does the size of the seeds. A rank under TOLERANCE counts as none.
    """
    links, seeds = scratch.write(links, f"{tag}-links"), scratch.write(seeds, f"{tag}-seeds")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rank, k = scratch.write(seeds.select("host", F.col("seed").alias("rank")), f"{tag}-0"), 0
    while True:
        before, k = rank, k + 1
        for _ in range(CUT_EVERY):
            sent = links.join(rank.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            rank = sent.join(seeds, "host", "full_outer").select("host", (DAMPING * zero("got") + (1 - DAMPING) * zero("seed")).alias("rank"))
        rank = scratch.write(rank, f"{tag}-{k}")
        both = rank.join(before.withColumnRenamed("rank", "old"), "host", "full_outer")
        change, total = both.agg(F.sum(F.abs(zero("rank") - zero("old"))), F.sum("rank")).head()  # one row
        scratch.drop(f"{tag}-{k - 1}")
        if not total or change <= TOLERANCE * total:
            return rank.select("host", (F.col("rank") / F.lit(total or 1.0)).alias("rank"))


def judge(pages: DataFrame, rules: Sequence[Rule], ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html); other columns are ignored.

    A rule decides where one fits. Elsewhere the host is blocked if its distrust is over ratio times its trust, each of them a share of
    1 over all hosts: trust starts from hosts in proportion to the share of their pages that a rule allows and follows links, distrust
    starts from the share of blocked pages and goes against links. A host that neither reaches, and a url
    without a host, is allowed. A null url or one without :// has an empty host and path; null html has no links.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    ruled = named.withColumn("rule", rule).withColumn("own", verdict)
    links = scratch.write(host_links(named), "links")
    count = lambda v: F.count(F.when(F.col("own") == v, 1))
    hosts = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
    hosts = scratch.write(hosts, "hosts")

    def shares(src: str, dst: str) -> DataFrame:
        total = links.groupBy(src).agg(F.sum("n").alias("total"))
        return links.join(total, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("total")).alias("share"))

    seed = lambda c: hosts.where(F.col(c) > 0).select("host", (F.col(c) / F.col("pages")).alias("seed"))
    trust = spread(shares("src", "dst"), seed("allowed"), scratch, "trust").withColumnRenamed("rank", "trust")
    distrust = spread(shares("dst", "src"), seed("blocked"), scratch, "distrust").withColumnRenamed("rank", "distrust")
    known = trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    known = scratch.write(known, "known")
    out = ruled.drop("html").join(known, "host", "left")
    by_host = F.when(F.col("distrust") > ratio * F.col("trust") + TOLERANCE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def oracle(rules: Sequence[Rule], ratio: float = 1.0) -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict of judge() over the view pages, by the same steps."""
    first = "://"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low.format(f"regexp_extract(coalesce(url, ''), '^[\\s\\S]*?{first}([^/?#]*)', 1)")
    path = f"regexp_extract(coalesce(url, ''), '^[\\s\\S]*?{first}[^/?#]*([^?#]*)', 1)"
    fit = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{{}}{r.name}'".replace("{}", f"{r.verdict}:") for r in sorted(rules, key=lambda r: (-len(r.name), r.name)))
    dst = low.format(f"regexp_extract(f, '^[\\s\\S]*?{first}([^/?#]*)', 1)")
    sql = f"""WITH n AS (SELECT page_id, {host} AS host, {path} AS path, html FROM pages),
ruled AS (SELECT *, CASE {fit} END AS hit FROM n),
hrefs AS (SELECT host, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]*)', 1)) AS h FROM n WHERE host <> ''),
f AS (SELECT host, CASE WHEN starts_with(h, '//') THEN 'http:' || h ELSE h END AS f FROM hrefs),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, CASE WHEN regexp_matches(f, '(?i)^[a-z][a-z0-9+.\\-]*://') THEN {dst} ELSE host END AS dst FROM f) WHERE dst <> '' GROUP BY ALL),
hosts AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (hit LIKE 'allow:%') AS allowed, count(*) FILTER (hit LIKE 'block:%') AS blocked FROM ruled WHERE host <> '' GROUP BY host)"""
    for tag, src, dst, seed in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        sql += f""",
{tag}l AS MATERIALIZED (SELECT {src} AS a, {dst} AS b, n / sum(n) OVER (PARTITION BY {src}) AS share FROM links),
{tag}0 AS MATERIALIZED (SELECT host, {seed} / pages AS rank FROM hosts WHERE {seed} > 0)"""
        for k in range(1, STEPS + 1):
            sql += f""",
{tag}{k} AS MATERIALIZED (SELECT host, {DAMPING} * coalesce(got, 0) + {1 - DAMPING} * coalesce(s.rank, 0) AS rank FROM (SELECT b AS host, sum(rank * share) AS got FROM {tag}l JOIN {tag}{k - 1} r ON r.host = a GROUP BY b) FULL JOIN {tag}0 s USING (host))"""
    return sql + f""",
t AS MATERIALIZED (SELECT host, rank / sum(rank) OVER () AS rank FROM t{STEPS}), d AS MATERIALIZED (SELECT host, rank / sum(rank) OVER () AS rank FROM d{STEPS})
SELECT page_id, host, path, substr(hit, 7) AS rule, coalesce(substr(hit, 1, 5), CASE WHEN coalesce(d.rank, 0) > {ratio} * coalesce(t.rank, 0) + {TOLERANCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN t USING (host) LEFT JOIN d USING (host)"""
