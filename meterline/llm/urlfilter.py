"""URL filtering by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8  # the short hash: the first 4 bytes of the digest
BROADCAST_RULES = 100_000  # more rules than this are joined by a shuffle


def split_url(url):
    """Host and path columns of a url; both empty for null or a url without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge the ``url`` of every page by ``rules`` (host, path, verdict).

    Each distinct (host, longest relevant path head) is expanded into all host suffixes, and these, where rules have such a
    host, into path prefixes of the lengths that its rules have. The expressions meet the rules by an
    equi-join on the first 4 bytes of their SHA-256; the full digest confirms. Of the rules that fit, the
    longest wins, and of equal ones ``block``. A url that no rule fits gets ``default``.

    Returns page_id, url, host, path, rule, verdict: a row for each row of ``pages``,
    repeated ones and those with null ids included. A null url, or one without ``://``, has an
    empty host and path, which no rule fits. Rules with a null or empty host fit nothing.
    """
    digest = lambda c: F.sha2(c, 256)
    rules = (
        rules.select(
            F.translate(F.col("host"), UPPER, LOWER).alias("host"),
            F.coalesce(F.col("path"), F.lit("")).alias("path"),
            F.col("verdict"),
        )
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # 'block' is after 'allow'
        .select(
            "host",
            F.concat("host", "path").alias("rule"),
            F.length("path").alias("n"),
            "verdict",
            # the character \x01 can't stand in a host: it keeps host and path apart
            digest(F.concat_ws("\x01", "host", "path")).alias("rule_digest"),
        )
        .withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    )
    hosts = rules.groupBy("host").agg(F.collect_set("n").alias("lengths")).withColumn("rule_digest", digest(F.col("host")))
    hosts = hosts.select("lengths", "rule_digest", F.substring("rule_digest", 1, PREFIX_HEX).alias("short"))
    n_rules, longest = rules.agg(F.count("*"), F.max("n")).first()
    if n_rules <= BROADCAST_RULES:
        rules, hosts = F.broadcast(rules), F.broadcast(hosts)

    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("head", F.substring("path", 1, longest or 0))
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    known = (
        judged.where("host <> ''")
        .select("host", "head")
        .distinct()
        .select("host", "head", F.explode(suffixes).alias("suffix"))
        .withColumn("digest", digest(F.col("suffix")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .join(hosts, "short")
        .where("digest = rule_digest")
    )
    heads = F.transform(
        F.filter("lengths", lambda n: n <= F.length("head")), lambda n: F.substring(F.col("head"), F.lit(1), n)
    )
    expressions = (
        known.select("host", "head", "suffix", F.explode(heads).alias("prefix"))
        .withColumn("digest", digest(F.concat_ws("\x01", "suffix", "prefix")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    # Written, so that the join's sides are plain shuffles, of which Spark splits a hot host's.
    found = staged(
        expressions.join(rules.drop("host"), "short")
        .where("digest = rule_digest")
        .groupBy("host", "head")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "verdict", "rule")).alias("won")),
        "url-verdicts",
    )
    return judged.join(found, ["host", "head"], "left").select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"),
    )
