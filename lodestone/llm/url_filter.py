"""URL filters: host-suffix and path-prefix expressions joined to rules.

Each URL is expanded into the expressions a rule could be written as: the
suffixes of its host that have as many labels as some rule's host, with the
prefixes of its path that have the length of some rule's path; so a host of
very many labels costs no more expressions than a short one. Expressions and rules meet in an equi-join on the
first hex digits of their SHA-256; whole digests confirm, and the longest rule
wins. Distinct (host, path) pairs are expanded once, so that a URL repeated
often costs one expansion and its rows meet the answer in a join that the
runtime can split.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path and fits no rule; a rule with path ``/`` does not fit an empty
path. Among rules of one length the longer host wins, then block before
allow, then the smaller text. Repeated rows keep a row each; an empty table or
an empty rule list gives no rule; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules up to this many are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (rule, verdict), a rule being a host and a path like ``net/``."""
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], r, v) for r, v in rules]
    return spark.createDataFrame(rows, "r_host string, r_path string, rule string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _suffixes(host: Column, counts: Column) -> Column:
    """The suffixes of a host that have one of ``counts`` labels."""
    labels = F.split(host, r"\.", -1)
    fit = F.filter(counts, lambda n: n <= F.size(labels))
    return F.transform(fit, lambda n: F.array_join(F.slice(labels, -n, n), "."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = 8, url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules``: r_host, r_path, rule and verdict (see ``rule_table``)."""
    parts = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = rules.where(F.col("r_host") != "").dropDuplicates(["r_host", "r_path", "verdict"]).withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.char_length("r_path"))).alias("lengths"), F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.", -1)))).alias("labels")).first()
    lengths, counts = (F.array(*map(F.lit, facts[x])).cast("array<int>") for x in ("lengths", "labels"))
    side = rules.select(F.substring("digest", 1, prefix_digits).alias("prefix"), "digest", "rule", "verdict", F.char_length("r_host").alias("h"))
    if facts["n"] <= BROADCAST_RULES:
        side = F.broadcast(side)
    paths = F.filter(lengths, lambda n: n <= F.char_length("path"))
    expressions = F.flatten(
        F.transform(_suffixes(F.col("host"), counts), lambda h: F.transform(paths, lambda n: _digest(h, F.substring(F.col("path"), F.lit(1), n))))
    )
    known = (
        parts.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("own"))
        .withColumn("prefix", F.substring("own", 1, prefix_digits))
    )
    rank = F.struct(F.char_length("rule").alias("n"), F.col("h"), (F.col("verdict") == "block").alias("b"))
    best = (
        known.join(side, "prefix").where(F.col("own") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(rank.alias("r"), "rule", "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    # pages without a host, which may be many, have no rule and need no join
    met = parts.where("host <> ''").join(best, ["host", "path"], "left")
    none = parts.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    return met.unionByName(none).select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
