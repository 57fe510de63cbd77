"""URL filters: host-suffix and path-prefix expressions, looked up by hash prefix, confirmed by full digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8  # of the digest: the 32-bit keys that are joined


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from after the first :// to /, ?, # or the end, A-Z lower-cased. Path: from there to ?, # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of every URL.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all
    subdomains if the path starts with the rule's. The longest rule wins, then
    the one with the longer host; of equal rules with both verdicts block wins.
    URLs that no rule fits, null ones and those without :// (host and path
    empty) get ``default`` and a null rule. Columns of pages with the four names
    are replaced. Rules with a null part are left out. Every distinct URL is
    judged once, so that a URL that very many rows share costs one look-up.
    """
    host, path = host_and_path(F.col("__url"))
    own = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    own = own.select("*", digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"))
    own = own.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    sizes = sorted(r[0] for r in own.select(F.length("rule_path")).distinct().collect())  # one for each length of a rule's path
    urls = pages.select(F.col(f"`{url_col}`").alias("__url")).where("__url is not null").distinct().select("__url", host.alias("h"), path.alias("p")).where("h <> ''")
    labels = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sizes] or [F.lit(-1)]), lambda n: (n >= 0) & (n <= F.length("p"))), lambda n: F.substring(F.col("p"), F.lit(1), n))
    tried = urls.select("__url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("__url", "suffix", F.explode("prefixes").alias("prefix"))
    tried = tried.withColumn("full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = tried.join(F.broadcast(own), "short").where("full = rule_digest")
    else:  # expressions that very many URLs share look for their rules once
        fits = tried.select("short", "full").distinct().join(own, "short").where("full = rule_digest").drop("short")
        met = tried.join(fits, "full")
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"))
    best = met.groupBy("__url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    joined = pages.alias("d").join(best.alias("b"), F.col(f"d.`{url_col}`") == F.col("b.__url"), "left")
    url_host, url_path = host_and_path(F.col(f"d.`{url_col}`"))
    return joined.select(*[F.col(f"d.`{c}`") for c in keep], url_host.alias("host"), url_path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
